"""Range joins with ranges of any length and as-of joins over several units of time, against plain loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vitalspark.operators import joins


def test_range_join_of_any_length(spark):
    r = random.Random(3)
    spans = [0, 1, 3, 4, 5, 15, 16, 17, 255, 256, 70_000, 1 << 40]
    ranges = [(r.choice("ab"), n, a := r.randrange(-300, 300) - r.choice([0, s]), a + s) for n, s in enumerate(spans * 4)]
    ranges += [("a", 90, 7, 6), ("a", 91, None, 5), (None, 92, 0, 5), ("b", 93, -(1 << 63), (1 << 63) - 1), ("b", 94, 5, 5), ("b", 95, 5, 5)]
    points = [(r.choice("ab"), i, r.randrange(-400, 400)) for i in range(150)] + [("a", 900, None), (None, 901, 3), ("b", 902, (1 << 63) - 1)]
    got = joins.range_join(
        spark.createDataFrame(points, "k string, p int, at long"), spark.createDataFrame(ranges, "k string, n int, lo long, hi long"), ["k"], "at", "lo", "hi"
    )
    assert set(got.columns) == {"k", "p", "at", "n", "lo", "hi"}
    want = [(p, n) for k, p, x in points for j, n, lo, hi in ranges if k == j and k and None not in (x, lo, hi) and lo <= x <= hi]
    assert sorted((x["p"], x["n"]) for x in got.collect()) == sorted(want)


def test_a_long_range_costs_two_rows(spark):
    ranges = spark.createDataFrame([(0, 999_999), (5, 1_000_004), (123, 5_000_000_123), (7, 7)], "lo long, hi long")
    assert all(x["count"] <= 2 for x in joins.range_blocks(ranges, "lo", "hi").groupBy("lo").count().collect())


def test_range_join_without_ranges(spark):
    points = spark.createDataFrame([("a", 1)], "k string, at int")
    assert joins.range_join(points, spark.createDataFrame([], "k string, lo int, hi int"), ["k"], "at", "lo", "hi").count() == 0


def test_asof_over_several_days(spark):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(hours=r.randrange(0, 240))
    snaps = [(h, at(), r.randrange(100)) for h in ("a", "b", None) for _ in range(8)] + [("a", None, 5), ("a", start, None), ("a", start, 1), ("a", start, 3)]
    samples = [(h, i, at()) for i in range(120) for h in ("a", "b", "c", None)] + [("a", 500, None)]
    got = joins.asof_snapshot(
        spark.createDataFrame(samples, "h string, i int, snap_time timestamp_ntz"),
        spark.createDataFrame(snaps, "h string, snap_start timestamp_ntz, begin_snap int"),
        ["h"],
    )

    def newest(h, t):
        open_ = [(s, n) for g, s, n in snaps if g == h and None not in (s, n, t) and s <= t]
        return max(open_)[1] if open_ else None

    assert got.columns == ["h", "i", "snap_time", "begin_snap"]
    key = lambda x: (x[1], str(x[0]))
    assert sorted(map(tuple, got.select("h", "i", "begin_snap").collect()), key=key) == sorted([(h, i, newest(h, t)) for h, i, t in samples], key=key)


def test_one_host_lies_in_several_tasks(spark):
    t = F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz")
    samples = spark.range(24 * 64).select(F.lit("a").alias("h"), t.alias("snap_time"), "id")
    snaps = spark.range(0, 24 * 64, 30).select(F.lit("a").alias("h"), t.alias("snap_start"), F.col("id").alias("begin_snap"))
    got = joins.asof_snapshot(samples, snaps, ["h"])
    assert got.where("begin_snap <> floor(id / 30) * 30 or begin_snap is null").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(h" in plan and "__unit" in plan.split("hashpartitioning(h")[1].split(")")[0]
