"""Streams that learn (S4) and the load chain with its ledger (S3): failures between steps, repeated batches, late days."""

import random

import pytest
from pyspark.sql import functions as F

from vitalspark.plans import anomaly
from vitalspark.sinks import KeyedTable
from vitalspark.streaming import jobs
from vitalspark.streaming.logs import BatchLog

COLUMNS = "hostname string, snap_time timestamp_ntz, object string, value double"


def _samples(days, hosts=("a", "b", None), seed=1):
    r = random.Random(seed)
    return [(h, f"2024-01-{d:02d} {r.randrange(24):02d}:00:00", o, r.choice([None, r.gauss(50, 5), r.gauss(50, 30)])) for d in days for h in hosts for o in ("x", "y") for _ in range(2)]


def _frame(spark, rows):
    text = spark.createDataFrame(rows, "hostname string, snap_time string, object string, value double")
    return text.withColumn("snap_time", F.to_timestamp_ntz("snap_time"))


def _plain(df):
    r = lambda x: None if x is None else round(x, 6)
    return sorted(
        (str(x["hostname"]), x["object"], str(x["day"]), r(x["metric_value"]), x["baseline_n"], r(x["baseline_mean"]), r(x["baseline_stddev"]), x["fallback"], r(x["z_score"]), x["severity"])
        for x in df.collect()
    )


def _whole(spark, rows):
    return _plain(anomaly.host_anomalies(_frame(spark, rows).withColumn("day", F.to_date("snap_time")), 5, 0.5))


def test_learned_hosts_equal_the_backfill_whatever_the_order(spark, tmp_path):
    learned = jobs.LearnedHosts(spark, str(tmp_path), every=2)
    seen = []
    loads = [[3, 4, 9], [10], [], [1, 2, 9], [12, 11], [5]]  # the second last adds to later days, the last changes a fallback
    for number, days in enumerate(loads):
        rows = _samples(days, seed=number)
        seen += rows
        for _ in range(2 if number in (3, 4) else 1):  # a repeated batch counts once, also where it merges
            learned.learn(_frame(spark, rows), number, 5, 0.5)
        if number >= 3:
            assert _plain(learned.anomalies()) == _whole(spark, seen)
    assert len(_whole(spark, seen)) > 5
    assert learned.points._complete() == [1, 3] and learned.points._numbers("batch") == [2, 3, 4, 5]


def test_learning_stream(spark, tmp_path):
    rows = _samples(range(1, 20))
    for k in range(3):
        _frame(spark, rows[k::3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.learning_host_stream(stream, str(tmp_path / "log"), 5, 0.5, once=True).awaitTermination()
    assert _plain(jobs.LearnedHosts(spark, str(tmp_path / "log")).anomalies()) == _whole(spark, rows)


def test_batch_log_without_a_complete_merge(spark, tmp_path):
    total = lambda df: df.groupBy("k").agg(F.sum("v").alias("v"))
    log = BatchLog(spark, str(tmp_path), spark.createDataFrame([], "k int, v bigint").schema, total, every=3)
    assert log.read().count() == 0
    for n in range(3):
        log.append(n, spark.createDataFrame([(1, n)], "k int, v bigint"))
    (tmp_path / "upto=2").mkdir()  # a merge that was cut off
    assert log.read().collect() == [(1, 3)]
    for n in range(3, 8):
        log.append(n, spark.createDataFrame([(1, n)], "k int, v bigint"))
    assert log.read().collect() == [(1, 28)] and log._numbers("batch") == [3, 4, 5, 6, 7]


class Stop(Exception):
    pass


@pytest.mark.parametrize("broken", ["insert", "refresh", "detect"])
def test_chain_goes_on_after_a_failure(spark, tmp_path, broken):
    source, checkpoint = tmp_path / "in", str(tmp_path / "log")
    for k in range(2):
        spark.createDataFrame([("d%d" % (i % 2), i, k) for i in range(k, k + 4)], "dbname string, id int, load int").coalesce(1).write.mode("append").parquet(str(source))
    facts, rollup = KeyedTable(spark, str(tmp_path / "facts"), ["dbname"]), KeyedTable(spark, str(tmp_path / "rollup"), ["dbname"])
    runs, fail = [], [broken]

    def step(name, work):
        def run(touched):
            runs.append(name)
            work(touched)
            if name in fail:  # after its effect, before it is marked
                fail.remove(name)
                raise Stop(name)

        return name, run

    def load(batch):
        runs.append("load")
        if "insert" in fail and runs.count("load") == 2:
            fail.remove("insert")
            raise Stop("load")
        return batch

    count = lambda t: rollup.refresh(t, lambda keys: facts.read().join(keys, "dbname", "left_semi").groupBy("dbname").agg(F.count("*").alias("n")))
    steps = [step("refresh", count), step("detect", lambda t: t.count())]

    def start():
        stream = spark.readStream.schema("dbname string, id int, load int").option("maxFilesPerTrigger", 1).parquet(str(source))
        q = jobs.chain_stream(stream, load, facts, ["dbname", "id"], steps, checkpoint, ["dbname"], once=True)
        q.awaitTermination()

    with pytest.raises(Exception, match="Stop"):
        start()
    start()
    assert sorted(r["id"] for r in facts.read().collect()) == [0, 1, 2, 3, 4]
    assert sorted(map(tuple, rollup.read().select("dbname", "n").collect())) == [("d0", 3), ("d1", 2)]
    again = {"insert": "load", "refresh": "refresh", "detect": "detect"}[broken]
    assert {n: runs.count(n) for n in ("load", "refresh", "detect")} == {n: 2 + (n == again) for n in ("load", "refresh", "detect")}
    before = list(runs)
    start()  # nothing new
    assert runs == before


def test_refresh_empties_what_has_no_rows(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    keys = spark.createDataFrame([("a:b",), ("c",)], "k string")
    rows = spark.createDataFrame([(1, "a:b"), (2, "c"), (3, "d")], "v int, k string")
    t.refresh(rows, lambda _: rows)
    t.refresh(keys, lambda ks: rows.where("v = 2").join(ks, "k", "left_semi").select("v", "k"))
    assert sorted((r["v"], r["k"]) for r in t.read().collect()) == [(2, "c"), (3, "d")]


def test_report_files_are_written_by_several_tasks(spark, sf_dir):
    """Small reports, however many, are not left to one task; each content lies in two files."""
    import glob
    import re

    from vitalspark.queries.jobs import _report_files

    found = glob.glob(_report_files(spark, sf_dir) + "/name=*/part-*.txt")
    writers = {re.search(r"part-(\d+)", f).group(1) for f in found}
    contents = [open(f).read() for f in found]
    assert len(writers) == spark.sparkContext.defaultParallelism
    assert len(found) == len({f.split("/")[-2] for f in found}) == 2 * len(set(contents))
