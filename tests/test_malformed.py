"""Texts that aren't perfect: no file ends a job, what can't be read comes out as rejected lines."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from vitalspark.functions.scalars import day_first_time, last_named
from vitalspark.sources import delimited, hostlog, plan_text, report

HEAD = "Linux 5.4.0 (web1) \t05/03/2024 \t_x86_64_\n"
BLOCK = "\n10:00:01 CPU %user %idle\n10:00:01 all 1.0 99.0\n"
LOGS = {
    "blank": "\n\n" + HEAD + BLOCK,
    "banner": "sysstat version 12\n" + HEAD + BLOCK,
    "tenth": "# x\n" * 9 + HEAD + BLOCK,
    "eleventh": "# x\n" * 10 + HEAD + BLOCK,
    "clock": HEAD + "\n10:00:01 CPU %user %idle\n25:61:61 all 1.0 99.0\n13:00:01 PM all 1 2\n10:00:02 all 2.0 98.0\n",
    "names": HEAD + "\n10:00:01 CPU %user %user %idle\n10:00:01 all 1.0 3.0 96.0\n",
    "torn": HEAD + "\n10:00:01 CPU %user %idle\n10:00:01 all 1.0\n",
    "more": HEAD + "\n10:00:01 CPU %user %idle\n10:00:01 all 1.0 99.0 7 7\n",
    "noise": HEAD + BLOCK + "\n" * 8 + "10:00:01 CPU %user %idle\n*** lost\n10:00:02 all 1.0 99.0\nAVERAGE: all 1 1\n",
    "restart": HEAD + "\n10:00:01 CPU %user %idle\n10:00:01 LINUX RESTART (8 CPU)\n10:00:01 PM all 1.0 99.0\n",
    "day": HEAD.replace("05/03", "13/45") + BLOCK,
    "empty": "",
    "null": None,
    "short": HEAD,
}
GOOD = {"blank": 1, "banner": 1, "tenth": 1, "clock": 1, "names": 1, "more": 1, "noise": 1, "restart": 1}
BAD = {
    ("eleventh", "no date"), ("eleventh", "unreadable"), ("clock", "bad time"), ("torn", "few cells"), ("noise", "no header"), ("noise", "unreadable"), ("day", "bad time")
}


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(list(LOGS.items()), "path string, content string")


def test_logs(logs):
    got = hostlog.log_lines(logs).collect()
    assert {p: sum(r["path"] == p for r in got) for p in {r["path"] for r in got}} == GOOD
    assert all(r["hostname"] == "web1" and r["section"] == "CPU" for r in got)
    by_path = {r["path"]: r for r in got}
    assert by_path["names"]["fields"] == {"CPU": "all", "%user": "3.0", "%idle": "96.0"}
    assert by_path["more"]["fields"] == {"CPU": "all", "%user": "1.0", "%idle": "99.0"}
    assert by_path["restart"]["snap_time"] == datetime(2024, 5, 3, 22, 0, 1)
    assert by_path["clock"]["snap_time"] == datetime(2024, 5, 3, 10, 0, 2)


def test_rejected_lines(logs):
    got = hostlog.rejected_lines(logs).collect()
    assert {(r["path"], r["reason"]) for r in got} == BAD
    for r in got:
        assert LOGS[r["path"]].split("\n")[r["line_no"] - 1] == r["line"]
    assert next(r["hostname"] for r in got if r["path"] == "eleventh") == hostlog.UNKNOWN


def test_typed_tables_of_bad_logs(logs):
    rows = hostlog.log_lines(logs, "5 hours 30 minutes")
    assert hostlog.cpu(rows).count() == sum(GOOD.values())
    for kind in hostlog.PLAIN:
        assert hostlog.plain(rows, kind).collect() == []


TIMES = {
    "03-May-24 10:00:05": datetime(2024, 5, 3, 10, 0, 5), "2024-05-03 10:00:00": datetime(2024, 5, 3, 10), "2024-05-03T10:00:00.25": datetime(2024, 5, 3, 10),
    "03/05/2024 10:00": datetime(2024, 5, 3, 10), "3.5.24 1:02:03 pm": datetime(2024, 5, 3, 13, 2, 3), "05/13/2024 00:00": datetime(2024, 5, 13),
    "13/05/2024": datetime(2024, 5, 13), "3 MAY 1999 12:00 AM": datetime(1999, 5, 3), "03-may-70 00:00": datetime(1970, 5, 3), "30-Feb-24 10:00:00": None,
    "garbage": None, "": None, None: None, "03-Xyz-24 10:00:00": None, "03/05/2024 25:00": None, "03/05/2024 junk": None, "99/99/2024 10:00": None
}


def test_day_first_times(spark):
    got = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", day_first_time(F.col("t")).alias("x")).collect()
    assert {r["t"]: r["x"] for r in got} == TIMES


INFO = '<table summary="This table displays database instance information"><tr><th>DB Name</th><th>Instance</th><th>Inst Num</th></tr><tr><td>{}</td><td>i1</td><td>{}</td></tr></table>'
SNAP = '<table summary="This table displays snapshot information"><tr><th></th><th>Snap Id</th><th>Snap Time</th></tr><tr><td>Begin Snap:</td><td>{}</td><td>{}</td></tr></table>'


def test_reports(spark):
    files = {
        "good": INFO.format("d", 1) + SNAP.format(7, "03/05/2024 10:00"), "time": INFO.format("d", 1) + SNAP.format(7, "garbage"), "snap": INFO.format("d", "x") + SNAP.format("n/a", ""),
        "none": "<html>", "empty": "", "null": None, "open": INFO.format("d", 1) + "<table><tr><td>x"
    }
    rows = report.report_rows(spark.createDataFrame(list(files.items()), "path string, content string"))
    got = {r["path"]: (r["dbname"], r["instnum"], r["begin_snap"], r["snap_time"]) for r in report.metadata(rows).collect()}
    assert got == {"good": ("d", 1, 7, datetime(2024, 5, 3, 10)), "time": ("d", 1, 7, None), "snap": ("d", None, None, None), "open": ("d", 1, None, None)}
    bad = {(r["path"], r["reason"]) for r in report.metadata_rejects(rows).collect()}
    assert bad == {("time", "bad snap time"), ("snap", "no snapshot"), ("open", "no snapshot")}


def test_report_rows_leave_while_parsing(spark, monkeypatch):
    """Rows of many and long reports leave in small batches, with the report's metadata in each."""
    rows = "".join(f"<tr><td>e{i}</td><td>{i}</td></tr>" for i in range(3000))
    content = INFO.format("d", 1) + SNAP.format(7, "03/05/2024 10:00") + f"<h3>Waits</h3><table><tr><th>Event</th><th>Waits</th></tr>{rows}</table>"
    got = report.report_rows(spark.createDataFrame([(f"p{k}", content) for k in range(5)], "path string, content string"))
    assert got.where("heading = 'Waits' and row_no >= 0 and header['snapid'] = '7' and cells['Waits'] = cast(row_no as string)").count() == 15_000


def test_plan_with_a_repeated_name(spark):
    text = "SQL_ID q1\nSELECT 1\nPlan hash value: 5\n| Id | Operation | Name | Rows | Rows |\n| 0 | SCAN | T | 1 | 2 |\n| 1 | SEEK |\n"
    got = plan_text.plan_steps(spark.createDataFrame([("p", text), ("q", ""), ("r", None)], "path string, content string")).collect()
    assert [(r["step_id"], r["operation"], r["object_name"], r["rows"]) for r in got] == [(0, "SCAN", "T", 2.0), (1, "SEEK", None, None)]


def test_csv_by_each_files_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("section,id,name,value\ns, 1,n1,v1\ns,2,n2\n")
    (tmp_path / "b.csv").write_text("value,Section,name,id\nv3,S,n3,3\n\nv4,other,n4,4\n")
    (tmp_path / "c.csv").write_text("id,section,id\n5,s,6\n")
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    got = delimited.sectioned_csv(spark, str(tmp_path), {"s": ["id", "name", "value"]})["s"].collect()
    assert sorted(map(tuple, got), key=str) == [(" 1", "n1", "v1"), ("3", "n3", "v3"), ("6", None, None)]
    assert [(r["path"].rsplit("/", 1)[1], r["line"]) for r in delimited.csv_rejects(spark, str(tmp_path)).collect()] == [("a.csv", "s,2,n2")]
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "d.csv").write_text("x,y\n1,2\n")
    assert delimited.sectioned_csv(spark, str(empty), {"s": ["id"]})["s"].columns == ["id"]


def test_last_named(spark):
    rows = [(["a", "b", "a"], ["1", "2", "3"]), (["a", "a"], ["1"]), ([], ["1"]), (["a"], []), (None, ["1"])]
    got = spark.createDataFrame(rows, "n array<string>, c array<string>").select(last_named("n", "c").alias("m")).collect()
    assert [r["m"] for r in got] == [{"b": "2", "a": "3"}, {"a": "1"}, {}, {}, None]


def test_header_cells_are_not_cast_to_numbers(spark):
    """What a header's cells are is told as a cast would, but words that begin like no number are not cast."""
    words = ["%user", "CPU", "kbmemfree", "IFACE", "intr/s", "none", "1", "-1.5e3", "+.5", ".", "-", "", "NaN", "nano", "-inf", "Infinity", "+Infinity", "0x1p3", "1d", "1x", "\x01 7", "e5", "\u0660"]
    d = spark.createDataFrame([(w,) for w in words], "w string")
    assert d.where(~hostlog.no_number(F.col("w")).eqNullSafe(F.col("w").try_cast("double").isNull())).collect() == []
    files = spark.createDataFrame([("f", "x")], "path string, content string")
    plan = hostlog.classified_lines(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "(?i:nan|inf)" in plan
