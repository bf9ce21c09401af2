"""Rank selection, co-occurrence by bounds and step pairing against plain Python."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from vitalspark.operators import joins
from vitalspark.operators.ranks import exact_percentiles
from vitalspark.plans import rules


def values(seed):
    rng = random.Random(seed)
    out = [("a", rng.gauss(0, 1)) for _ in range(500)] + [("a", 0.25)] * 400  # one value many times
    out += [("b", 10.0 ** rng.randrange(-300, 300)) for _ in range(301)]  # one bucket holds nearly all
    out += [("c", 7.0), ("d", None), (None, 1.0), (None, 2.0), ("e", -3.0), ("e", 5.0)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("buckets,levels", [(4096, 2), (2, 1), (3, 4), (1, 0)])
def test_percentiles(spark, buckets, levels):
    rows = values(buckets)
    at = [0.0, 0.1, 0.5, 0.9, 0.95, 1.0]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at, buckets, levels).collect()
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    assert {r["k"] for r in got} == set(groups) and len(got) == len(groups)
    for r in got:
        for p in at:
            want = pd.Series(groups[r["k"]]).quantile(p)
            assert r[f"p{round(p * 100)}"] == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_percentiles_of_everything_and_of_nothing(spark):
    df = spark.createDataFrame([(i / 3,) for i in range(1000)], "v double")
    assert exact_percentiles(df, [], "v", [0.5]).first()["p50"] == pytest.approx(999 / 6)
    assert exact_percentiles(df.where("false"), [], "v", [0.5]).collect() == []


def test_percentiles_of_means_that_are_summed_anew(spark):
    """Each reading brings the values off in their last digits, as sums of another order are; no value leaves the bounds of an earlier pass."""
    noisy = F.udf(lambda x: x * (1 + random.uniform(-1e-13, 1e-13)), "double").asNondeterministic()
    df = spark.range(5000, numPartitions=3).select((F.col("id") % 2).alias("k"), noisy((F.col("id") * 7919 % 5003 + 1).cast("double")).alias("v"))
    want = {k: pd.Series([float(i * 7919 % 5003 + 1) for i in range(k, 5000, 2)]) for k in (0, 1)}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = exact_percentiles(df, ["k"], "v", [0.0, 0.1, 0.4, 0.9, 1.0]).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert len(got) == 2
    for r in got:
        for p in (0.0, 0.1, 0.4, 0.9, 1.0):
            assert r[f"p{round(p * 100)}"] == pytest.approx(want[r["k"]].quantile(p), rel=1e-9)


def test_percentiles_gather_nothing(spark):
    """No aggregate collects values: buckets, sums and extremes only."""
    df = spark.createDataFrame(values(1), "k string, v double")
    plan = exact_percentiles(df, ["k"], "v", [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list(v" not in plan


@pytest.mark.parametrize("seed,least", [(1, 0.0), (2, -5.0)])
def test_cooccurrence_top(spark, seed, least):
    rng = random.Random(seed)
    score = lambda: round(rng.uniform(least, 10) ** 3, 2)
    a = [(s, e, score()) for s in range(12) for e in rng.sample(range(60), 40)]
    b = [(s, e, score()) for s in range(12) for e in rng.sample(range(80), 50)]
    signal, snaps = defaultdict(float), defaultdict(int)
    for s, e, x in a:
        for s2, o, y in b:
            if s == s2:
                signal[e, o] += x * y
                snaps[e, o] += 1
    left = spark.createDataFrame(a, "snap int, sql_id int, score double")
    right = spark.createDataFrame(b, "snap int, object_name int, score double")
    for k in (1, 25, 100_000):
        got = [(r["sql_id"], r["object_name"], r["snaps"]) for r in joins.cooccurrence_top(left, right, k, ["snap"]).collect()]
        best = sorted(signal, key=lambda p: (-signal[p], p))[:k]
        assert [g[:2] for g in got] == best and [g[2] for g in got] == [snaps[p] for p in best]
    assert joins.cooccurrence_top(left.where("false"), right, 3, ["snap"]).collect() == []


def test_cooccurrence_top_sums_few_pairs(spark):
    """A few strong entities among many weak ones: the last sum sees only what can reach the top, 16 of 40,000 pairs."""
    side = lambda name: spark.range(400).selectExpr("cast(id % 4 as int) as snap", f"cast(id as int) as {name}", "case when id < 8 then 100D else 1D end as score")
    a, b = side("sql_id"), side("object_name")
    top = joins.cooccurrence_top(a, b, 10, ["snap"])
    assert a.join(b, "snap").count() == 40_000 and top.count() == 10 and top.agg(F.sum("snaps")).first()[0] == 10
    bounded = joins.bounded_sides(a, b, 10, ["snap"])
    assert bounded[0].join(bounded[1], "snap").count() == 16
    pairs = joins.cooccurrence_top(a, b, 1 << 20, ["snap"], probes=4).count()  # fewer pairs than asked for: nothing is left out
    assert pairs == 40_000


@pytest.mark.parametrize("least", [0.0, -5.0])
def test_cooccurrence_top_by_blocks(spark, least, monkeypatch):
    """Blocks that are multiplied give the pairs of the joins, ties and copies included; no row of a pair is joined but those of the best."""
    rng = random.Random(7)
    score = lambda: round(rng.uniform(least, 10) ** 3, 2)
    a = [(s, f"q{e}", score()) for s in range(12) for e in rng.sample(range(60), 40)]
    b = [(s, e, score()) for s in range(12) for e in rng.sample(range(80), 50)]
    a += [(s, f"{e}-copy", x) for s, e, x in a]
    left, right = spark.createDataFrame(a, "snap int, sql_id string, score double"), spark.createDataFrame(b, "snap int, object_name int, score double")
    calls, whole = [], joins._best_by_blocks
    monkeypatch.setattr(joins, "_best_by_blocks", lambda *x: calls.append(x) or whole(*x))
    for k in (1, 60):
        by_blocks = joins.cooccurrence_top(left, right, k, ["snap"], probes=8, joined=0, block_rows=300)
        want = joins._signals(left.withColumnRenamed("score", "s1"), right.withColumnRenamed("score", "s2"), ["snap"])
        want = want.orderBy(F.desc(F.round("signal", 6)), "sql_id", "object_name").limit(k)
        order = lambda df: [(round(r["signal"], 6), r["sql_id"], r["object_name"], r["snaps"]) for r in df.collect()]
        got = order(by_blocks)
        assert [g[0] for g in got] == [w[0] for w in order(want)] and len(set(got)) == k
        every = {(r["sql_id"], r["object_name"]): (round(r["signal"], 6), r["snaps"]) for r in want.collect()}
        assert all(every.get((g[1], g[2]), (g[0], g[3])) == (g[0], g[3]) for g in got)
    assert len(calls) == 2


def paired(before, after):
    """Greedy: each step takes the first unused equal one; what is left is paired by position."""
    used, out, rest = set(), [], []
    for s, what in before:
        hit = next((t for t, w in after if w == what and t not in used), None)
        if hit is None:
            rest.append(s)
        else:
            used.add(hit)
            out.append((s, hit, "same"))
    free = [t for t, _ in after if t not in used]
    for i in range(max(len(rest), len(free))):
        s, t = (rest[i] if i < len(rest) else None), (free[i] if i < len(free) else None)
        out.append((s, t, "added" if s is None else "removed" if t is None else "moved"))
    return out


def test_step_match(spark):
    rng = random.Random(4)
    sides = [{p: [(i, (rng.choice("ABC"), rng.choice(["x", "y", None]))) for i in range(rng.randrange(0, 9))] for p in range(30)} for _ in range(2)]
    frames = [
        spark.createDataFrame([(p, i, op.lower() if side else op, ob, "n") for p, steps in plans.items() for i, (op, ob) in steps], "plan int, step_id int, operation string, object_name string, op string")
        for side, plans in enumerate(sides)
    ]
    got = joins.step_match(*frames, ["plan"])
    want = {(p, *x) for p in range(30) for x in paired(sides[0][p], sides[1][p])}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2
    assert joins.step_match(frames[0].where("false"), frames[1].where("false"), ["plan"]).collect() == []


def test_all_findings_have_their_texts(spark):
    r = rules.Rule("e", "instance_efficiency", "soft_parse_ratio", "value < 90", "high", "t", "cause", ("one", "two"), ("select 1",), ("x",))
    none = lambda s: spark.createDataFrame([], s)
    waits, sqls = none("db string, event string, pct_db_time double, avg_wait_ms double, total_waits long"), none("db string, sql_id string, elapsed_time_s double, cpu_time_s double, parse_calls double, executions double")
    segments = none("db string, owner string, object_name string, metric string, value double, pct double")
    e = spark.createDataFrame([("d", "Soft Parse %", 80.0), ("d", "Soft Parse %", 90.0), ("f", "Other", 1.0)], "db string, metric string, value double")
    got = rules.all_findings(waits, sqls, e, segments, [r], ["db"]).collect()
    assert [(x["db"], x["value"], x["root_cause"], x["resolution"], x["diagnostic_sql"], x["related_rules"]) for x in got] == [("d", 85.0, "cause", ["one", "two"], ["select 1"], ["x"])]
    assert rules.all_findings(waits, sqls, e, segments, [], ["db"]).collect() == []


def test_top_segments_hold_an_object_once(spark):
    """Aggregated by object, not by object and metric; NULL values, names of NULL and objects without a metric come out as they would by metric."""
    import re

    from vitalspark.operators import rollups

    rows = [("o", 1, "T", "a", 5.0), ("o", 1, "T", "a", None), ("o", 1, "T", "b", 1.0), ("o", 2, "T", "a", 5.0), (None, 3, None, "b", 9.0), ("p", 4, "I", "a", None), ("p", 5, "I", "c", 3.0)]
    long = spark.createDataFrame(rows, "owner string, object_name int, obj_type string, metric string, value double")
    out = rollups.top_segments(long, ["a", "b"], 3)
    got = sorted((r["metric"], r["rank_in_group"], r["object_name"], r["total"], r["avg_value"]) for r in out.collect())
    assert got == [("a", 1, 1, 5.0, 5.0), ("a", 2, 2, 5.0, 5.0), ("a", 3, 4, None, None), ("b", 1, 3, 9.0, 9.0), ("b", 2, 1, 1.0, 1.0)]
    grouped = re.findall(r"Aggregate \[([^\]]*)\]", out._jdf.queryExecution().optimizedPlan().toString())
    assert len(grouped) == 1 and "metric" not in grouped[0] and "object_name" in grouped[0]
