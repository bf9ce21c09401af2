"""Golden and metamorphic cases that the tables do not hold."""

import pytest
from pyspark.sql import functions as F

from vitalspark.functions import scalars as S
from vitalspark.operators import joins
from vitalspark.plans import anomaly, compare, rules
from vitalspark.sources import hostlog, plan_text, report


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,ms",
    [
        ("12us", 0.012),
        ("1,234.5", 1234.5),
        ("3ms", 3),
        ("2s", 2000),
        ("5ns", 5e-6),
        ("", None),
        (None, None),
        ("abc", None),
        ("ms", None),
        ("nan", None),
    ],
)
def test_to_ms(spark, text, ms):
    got = one(spark, text, S.to_ms)
    assert got == ms if ms is None else got == pytest.approx(ms)


@pytest.mark.parametrize("text,mb", [("2G", 2048), ("1.5M", 1.5), ("512K", 0.5), ("7", 7), ("4GB", 4096), ("", None), (None, None)])
def test_to_mb(spark, text, mb):
    assert one(spark, text, S.to_mb) == mb


def test_baseline_edges(spark):
    """One earlier row (no deviation), equal earlier rows (deviation 0), NULL values, and the fallback of a group without any baseline."""
    rows = [
        ("h", "one", 1, 5.0),
        ("h", "one", 2, 9.0),
        ("h", "same", 1, 4.0),
        ("h", "same", 2, 4.0),
        ("h", "same", 3, 4.0),
        ("h", "same", 4, 8.0),
        ("h", "null", 1, 1.0),
        ("h", "null", 2, 2.0),
        ("h", "null", 3, 3.0),
        ("h", "null", 4, None),
        ("g", "far", 1, 1.0),
        ("g", "far", 2, 3.0),
        ("g", "far", 90, 9.0),
    ]
    d = spark.createDataFrame(rows, "hostname string, object string, day_no int, value double")
    s = anomaly.point_stats(d, ["hostname", "object"], "day_no")
    got = {
        (r["object"], r["day_no"]): r
        for r in anomaly.detect(anomaly.rolling_baseline(s, ["hostname", "object"], "day_no", 30, 3, ["hostname"]), 0.0).collect()
    }
    assert got["same", 4]["z_score"] == 0.0 and got["same", 4]["baseline_n"] == 3
    assert got["null", 4]["metric_value"] == 0.0 and got["null", 4]["z_score"] == pytest.approx(-2.0)
    assert got["far", 90]["fallback"] and got["far", 90]["baseline_mean"] == 2.0
    assert ("one", 2) not in got


def test_log_with_am_pm_and_midnight(spark):
    text = (
        "Linux 5.4 (web1) \t01/31/24 \t_x86_64_\n\n11:50:01 PM     CPU     %user     %nice   %system   %iowait    %steal     "
        "%idle\n11:50:01 PM     all      1.50      0.00      2.00      3.00      0.00     93.50\n11:55:01 PM       0      "
        "1.00\n\nAverage:     all      9.00\n12:00:01 AM orphan 1\n"
    )
    d = spark.createDataFrame([("f", text), ("empty", ""), ("none", None)], "path string, content string")
    got = hostlog.cpu(hostlog.log_lines(d, "5 hours 30 minutes")).collect()
    assert [(r["cpu"], r["usr_pct"], r["idle_pct"], str(r["snap_time"])) for r in got] == [("all", 1.5, 93.5, "2024-02-01 05:20:01")]
    # a torn row is no idle host
    torn = {(r["line_no"], r["reason"]) for r in hostlog.rejected_lines(d).collect()}
    assert torn == {(5, "few cells"), (8, "no header")}


def test_plan_listing(spark):
    text = (
        "SQL_ID  abc, child number 0\n---\nselect 1\n  from t\n\nPlan hash value: 42\n\n---\n| Id  | Operation          | Name | Rows | "
        "Bytes | Cost (%CPU)|\n---\n|   0 | SELECT STATEMENT   |      |      |       |    12 (100)|\n|*  1 |  TABLE ACCESS FULL | T1   "
        "|  26K |   300 |   129K  (3)|\n---\n\nPredicate Information (identified by operation id):\n---\n\n   1 - filter(\"A\"=1 AND\n  "
        "            \"B\"=2)\n\nNote\n-----\n   - dynamic sampling\n\nSQL_ID  empty\n"
    )
    d = spark.createDataFrame([("f", text)], "path string, content string")
    got = plan_text.plan_steps(d).orderBy("step_id").collect()
    assert [(r["sql_id"], r["operation"], r["object_name"], r["rows"], r["cost"], r["depth"], r["predicate"]) for r in got] == [
        ("abc", "SELECT STATEMENT", None, None, 12.0, 0, None),
        ("abc", "TABLE ACCESS FULL", "T1", 26000.0, 129000.0, 1, 'filter("A"=1 AND "B"=2)'),
    ]
    assert plan_text.plan_steps(d, compat=True).where("step_id = 1").first()["cost"] is None
    heads = {r["sql_id"]: r for r in plan_text.plan_headers(plan_text.plans(d)).collect()}
    assert heads["abc"]["sql_text"] == "select 1 from t" and heads["abc"]["notes"] == "dynamic sampling" and heads["empty"][
        "plan_hash_value"
    ] is None


def test_report_headings(spark):
    """An exact heading wins over one that holds it; cells may have entities; empty sections give nothing."""
    html = (
        "<h3>SQL ordered by Reads (other)</h3><table><tr><th>SQL Id</th></tr><tr><td>wrong</td></tr></table><h3>SQL ordered by  "
        "Reads</h3><table><tr><th>Physical&#160;Reads</th><th>SQL "
        "Id</th></tr><tr><td>1,234</td><td>a1</td></tr><tr><td>&#160;</td><td>&nbsp;</td></tr></table><h3>SQL ordered by "
        "Gets</h3><table></table>"
    )
    rows = report.report_rows(spark.createDataFrame([("p", html), ("q", None)], "path string, content string"))
    by = {s.table: s for s in report.SECTIONS}
    assert [(r["sql_id"], r["physical_reads"]) for r in report.section(rows, by["sql_reads"]).collect()] == [("a1", 1234.0)]
    assert report.section(rows, by["sql_gets"]).count() == 0


def test_conditions_are_checked(spark):
    with pytest.raises(ValueError):
        rules.compile_condition("value > 1; drop", ["value"])
    with pytest.raises(ValueError):
        rules.compile_condition("java_method('x') > 1", ["value"])
    assert spark.range(1).select(F.lit(5.0).alias("value")).where(
        rules.compile_condition("value >= 5 and not (value > 6)", ["value"])
    ).count() == 1


def test_before_after_forms_agree(spark):
    rows = [("k1", "before", 1.0), ("k1", "before", 3.0), ("k1", "after", 4.0), ("k2", "after", 7.0), ("k3", "before", 0.0)]
    t = spark.createDataFrame(rows, "k string, tag_type string, v double")
    a = {r["k"]: (r["before_value"], r["after_value"]) for r in joins.before_after(t, ["k"], F.col("v")).collect()}
    side = lambda s: t.where(F.col("tag_type") == s).groupBy("k").agg(F.avg("v").alias("value"))
    b = {r["k"]: (r["before_value"], r["after_value"]) for r in joins.before_after_join(side("before"), side("after"), ["k"]).collect()}
    assert a == b == {"k1": (2.0, 4.0), "k2": (0.0, 7.0), "k3": (0.0, 0.0)}


def test_range_join_over_block_borders(spark):
    points = spark.createDataFrame([("a", i) for i in range(-40, 40)], "k string, at int")
    ranges = spark.createDataFrame([("a", -17, 17, "x"), ("a", 15, 16, "y"), ("b", 0, 9, "z")], "k string, lo int, hi int, tag string")
    got = sorted((r["at"], r["tag"]) for r in joins.range_join(points, ranges, ["k"], "at", "lo", "hi").collect())
    assert got == sorted([(i, "x") for i in range(-17, 18)] + [(15, "y"), (16, "y")])


def test_plateau_without_any(spark):
    c = spark.createDataFrame(
        [("a", 1, 10.0), ("a", 2, 5.0), ("b", 1, 10.0), ("b", 2, 9.99), ("b", 3, 1.0), ("c", 1, 0.0), ("c", 2, 0.0)],
        "k string, size int, cost double",
    )
    assert [(r["k"], r["size"]) for r in compare.plateau(c, ["k"], "size", "cost").collect()] == [("b", 2)]


def test_efficiency_pairs_and_plain_text_heading(spark):
    html = (
        "<p>Instance Efficiency Percentages (Target 100%)</p><table><tr><td>Buffer Nowait %:</td><td>99.9</td><td>Redo NoWait "
        "%:</td><td>1,00.0</td></tr><tr><td>Soft Parse %:</td><td></td></tr></table>"
    )
    rows = report.report_rows(spark.createDataFrame([("p", html)], "path string, content string"))
    assert sorted(
        (r["metric"], r["value"]) for r in report.efficiency(rows).collect()
    ) == [("Buffer Nowait %", 99.9), ("Redo NoWait %", 100.0)]


def test_schemas_cover_the_sources(spark):
    from vitalspark import schemas

    for s in [*report.SECTIONS, *report.SUMMARIES]:
        assert s.table in schemas.SNAPSHOT_TABLES and schemas.schema(s.table)
    for kind in hostlog.PLAIN:
        assert f"sar_{kind}" in schemas.HOST_TABLES


def _plan(spark, plan):
    """The operators of a query's optimised and executed plan, as text."""
    return plan._jdf.queryExecution().optimizedPlan().toString(), plan._jdf.queryExecution().executedPlan().toString()


def test_logs_and_listings_are_read_once(spark):
    """The content goes no further than the line split, so time grows with a file's length; each text is split and each report parsed once."""
    files = spark.createDataFrame([("f", "x\ny")], "path string, content string")
    for out in (hostlog.cpu(hostlog.log_lines(files)), plan_text.plan_steps(files)):
        logical, physical = _plan(spark, out)
        assert logical.count("posexplode(") == 1 and "content" not in logical.split("posexplode(")[0]
        assert physical.count("hashpartitioning(path") == 1
    assert _plan(spark, report.facts(files, "sql_reads"))[1].count("MapInArrow") == 1


def test_header_probe_reads_flags_from_their_columns(spark):
    html = (
        "<title>AWR Report for DB: ab$1, Inst: ab#2, Snaps: 3</title><table><tr><th>DB Name</th><th>Inst "
        "Num</th><th>Release</th><th>RAC</th><th>CDB</th></tr>"
        "<tr><td>AB$1</td><td>2</td><td>19.0.0.0.0</td><td>NO</td><td>YES</td></tr></table><table><tr><th>Con "
        "Name</th></tr><tr><td>pdb_7</td></tr></table>"
    )
    rows = report.header_probe(
        spark.createDataFrame([("r/x/one_12.html", html), ("r/Y/two_3.html", "<p>none</p>")], "path string, content string")
    ).orderBy("path").collect()
    got = {r["path"]: (r["dbname"], r["instance"], r["instnum"], r["release"], r["rac"], r["cdb"], r["pdb"]) for r in rows}
    assert got == {
        "r/x/one_12.html": ("AB$1", "AB#2", 2, "19.0.0.0.0", False, True, "PDB_7"),
        "r/Y/two_3.html": ("two", None, None, None, False, False, None),
    }


def test_plan_warnings_and_problems(spark):
    from vitalspark.plans import listings

    meta = spark.createDataFrame(
        [
            ("d", "ix", "INDEX", 100.0, 91, 5, 81.0, '[{"col":"A"}]', "UNIQUE", None),
            ("d", "t", "TABLE", 7.0, 31, 0, None, None, None, "RANGE"),
            ("e", "t", "TABLE", 9.0, None, 0, None, None, None, None),
        ],
        "dbname string, object_name string, object_type string, num_rows double, analysed_days int, blevel int, clustering_factor "
        "double, index_columns string, uniqueness string, partition_type string",
    )
    steps = spark.createDataFrame(
        [("p", 1, "d", 0, "FIXED TABLE FULL", "IX", 1.0, 5.0, None), ("p", 1, "d", 1, "PX TABLE ACCESS FULL", "T", 1.0, 20000.0, "f")],
        "path string, plan_no int, dbname string, step_id int, operation string, object_name string, rows double, cost double, "
        "predicate string",
    )
    got = {(r["object_name"], r["pattern"], r["severity"]) for r in listings.metadata_warnings(steps, meta).collect()}
    assert got == {
        ("ix", "Stale Statistics", "HIGH"),
        ("ix", "High Clustering Factor", "MEDIUM"),
        ("ix", "Deep B-tree Index", "HIGH"),
        ("ix", "Index Definition", "INFO"),
        ("t", "Stale Statistics", "MEDIUM"),
        ("t", "Table Size", "INFO"),
    }
    found = {(r["pattern"], r["step_id"]) for r in listings.plan_problems(steps).collect()}
    assert found == {("full scan", 0), ("full scan", 1), ("unbounded full scan", 0), ("high cost", 1)}


def test_snapshot_baselines_go_back_in_time(spark):
    """Five snapshots of uneven spacing: the first two lie further back than the baseline reaches from the last."""
    days = [1, 2, 50, 51, 52]
    facts = spark.createDataFrame(
        [("d", "i", k, "wait", "e", float(10 + k)) for k in range(5)],
        "dbname string, instance string, begin_snap int, source string, object string, value double",
    )
    times = spark.createDataFrame(
        [("d", "i", k, f"2024-01-01 00:00:{k:02d}", n) for k, n in enumerate(days)],
        "dbname string, instance string, begin_snap int, t string, n int",
    )
    times = times.select("dbname", "instance", "begin_snap", F.expr("to_timestamp(t) + make_interval(0, 0, 0, n)").alias("snap_time"))
    got = {
        r["begin_snap"]: (r["baseline_n"], r["baseline_mean"], r["fallback"])
        for r in anomaly.snapshot_anomalies(facts, times, 30, 0.0, min_samples=2).collect()
    }
    assert got[4] == (2, 12.5, False) and got[3] == (3, 11.0, True) and got[2] == (2, 10.5, True)


def test_sinks_spread_a_partition(spark, tmp_path):
    from vitalspark.sinks import KeyedTable

    t = KeyedTable(spark, str(tmp_path / "t"), ["p"])
    d = spark.range(100).select((F.col("id") % 2).alias("p"), "id", F.lit("x").alias("v"))
    t.insert_if_absent(d, ["p", "id"])
    t.insert_if_absent(d, ["p", "id"])
    t.delete(d.where("p = 0 or id < 10"), ["p", "id"])
    t.delete(d.where("p = 0 or id < 10"), ["p", "id"])
    assert sorted(r["id"] for r in t.read().collect()) == [i for i in range(11, 100) if i % 2]


def test_confidence_of_a_whole_frame_counts_without_a_window(spark):
    from vitalspark.plans.compare import confidence

    df = spark.range(3)
    assert {r.confidence for r in confidence(df).collect()} == {85}
    assert "Window" not in confidence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert confidence(df.where("id = 0")).first().confidence == 70


def test_drilldown_text_without_rule_or_rows(spark):
    from vitalspark.plans.drilldown import NO_RULE, drilldown_text

    found = spark.createDataFrame([], "section string, item string, amount double")
    rules = spark.createDataFrame([("sql", "9", "x")], "category string, rule_key string, rule_text string")
    got = {r.section: r.value for r in drilldown_text(found, "wait", "lock", rules).collect()}
    assert got == {"Focus": "wait: lock", "Recommendation": NO_RULE}


def test_a_metric_that_never_moved_has_no_spread(spark):
    """Also where the rounded sums around the series' mean would leave one; a true spread far below the mean stays."""
    flat = [("a", d, v) for d in range(1, 8) for v in (0.1, 0.1, 0.1)] + [("a", d, 7.3 + d) for d in range(8, 12)]
    fine = [("b", d, 1e6 + (d % 2) * 1e-3) for d in range(1, 8)] + [("b", 8, 1e6 + 1.0)]
    facts = spark.createDataFrame(flat + fine, "k string, d int, value double")
    got = anomaly.rolling_baseline(anomaly.point_stats(facts, ["k"], "d"), ["k"], "d", 90).collect()
    sd = {(r["k"], r["d"]): r["baseline_stddev"] for r in got}
    assert [sd["a", d] for d in range(2, 9)] == [0.0] * 7 and sd["a", 9] > 1
    assert abs(sd["b", 8] - 0.000534522) < 1e-7


def test_baseline_windows_are_evaluated_once(spark):
    """Each sum of a window is one expression of the plan, not one for each place where its value is used; points that can't come out go before the last shuffle."""
    facts = spark.createDataFrame([("a", "b", d, float(d)) for d in range(9)], "h string, k string, d int, value double")
    out = anomaly.rolling_baseline(anomaly.point_stats(facts, ["h", "k"], "d"), ["h", "k"], "d", 3, fallback_by=["h"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") == 2 + 4 + 4 + 1
    assert sorted((r["d"], r["baseline_n"], r["fallback"]) for r in out.collect()) == [(2, 2, True)] + [(d, 3, False) for d in range(3, 9)]


def test_points_of_several_columns_equal_those_of_melted_rows(spark):
    rows = [("a", 1, 1.0, 2), ("a", 1, 4.0, None), ("a", 2, None, None), (None, 1, 5.0, 7), ("a", None, 2.5, 1)]
    facts = spark.createDataFrame(rows, "k string, d int, x double, y int")
    got = anomaly.point_stats_of_columns(facts, ["k"], "d", {"first": "x", "second": "y"})
    melted = facts.selectExpr("k", "d", "x", "double(y) AS y").unpivot(["k", "d"], ["x", "y"], "c", "value").selectExpr("k", "d", "if(c = 'x', 'first', 'second') AS source", "value")
    want = anomaly.point_stats(melted, ["k", "source"], "d")
    columns = ["k", "source", "d", "n", "mean", "m2", "metric_value"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
