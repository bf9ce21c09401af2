"""Metadata of reports in one pass."""

from vitalspark.sources import report

INFO = '<table summary="database instance information"><tr><th>DB Name</th><th>Instance</th></tr><tr><td>{}</td><td>i</td></tr></table>'
SNAP = '<table summary="snapshot information"><tr><th></th><th>Snap Id</th><th>Snap Time</th></tr><tr><td>Begin Snap:</td><td>{}</td><td>{}</td></tr></table>'


def test_checked_metadata_is_one_pass_and_equals_the_joined_form(spark):
    files = {
        "good": INFO.format("d") + SNAP.format(7, "03/05/2024 10:00"), "time": INFO.format("d") + SNAP.format(7, "soon"), "two": INFO.format("") + SNAP.format("x", "soon"),
        "late": "<h3>Waits</h3><table><tr><th>a</th></tr></table>" + SNAP.format(8, "03/05/2024 11:00") + "<table></table>" + INFO.format("e"),
        "none": "<html>", "empty": "", "null": None, "bare": "<table></table>", "other": "<table><tr><td>x</td></tr></table>",
    }
    d = spark.createDataFrame(list(files.items()), "path string, content string")
    got = report.checked_metadata(d)
    rows = report.report_rows(d)
    want = report.metadata(rows).join(report.metadata_rejects(rows), "path", "left")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r["path"] for r in got.collect()} == {"good", "time", "two", "late"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_reports_are_parsed_in_many_tasks(spark, sf_dir):
    from vitalspark import catalog

    assert catalog.QUERIES["src2_report_times"](spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
