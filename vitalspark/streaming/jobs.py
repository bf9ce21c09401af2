"""Stream jobs S1-S4. A checkpoint folder replaces any queue of seen files, and retries are Spark's own."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import z_score, z_severity
from ..operators.select import newest_by
from ..plans import anomaly, rules as rulebook
from ..sinks import KeyedTable
from .logs import BatchLog, StepLedger


def file_stream(spark: SparkSession, path: str, glob: str = "*.html", max_files: int | None = None) -> DataFrame:
    """(path, content, hash, arrived) of new files; the hash is over the whole content."""
    r = spark.readStream.format("binaryFile").option("pathGlobFilter", glob)
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r
    return r.schema("path string, modificationTime timestamp, length long, content binary").load(path).select(
        "path",
        F.col("content").cast("string").alias("content"),
        F.sha2("content", 256).alias("hash"),
        F.col("modificationTime").alias("arrived"),
    )


def content_dedup(stream: DataFrame, within: str | None = "30 days") -> DataFrame:
    """Files of new content. State is bounded by the watermark on ``arrived``: a copy is known for ``within`` (an interval). None keeps all hashes for ever."""
    if within is None:
        return stream.dropDuplicates(["hash"])
    return stream.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["hash"])


def upsert_stream(
    stream: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    table: KeyedTable,
    keys: Sequence[str],
    checkpoint: str,
    after: Callable[[DataFrame], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """S3: each micro-batch is parsed by ``load``, inserted where absent, and handed to ``after`` (rollups, detection). A repeated batch changes
    nothing, since inserts are by key."""

    def step(batch: DataFrame, _: int) -> None:
        rows = load(batch).persist()
        try:
            if not rows.isEmpty():
                table.insert_if_absent(rows, keys)
                if after:
                    after(rows)
        finally:
            rows.unpersist()

    return _start(stream, step, checkpoint, once)


def _start(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="15 seconds")).start()


def chain_stream(
    stream: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    table: KeyedTable,
    keys: Sequence[str],
    steps: Sequence[tuple[str, Callable[[DataFrame], None]]],
    checkpoint: str,
    touched: Sequence[str] = ("dbname", "instance", "begin_snap"),
    once: bool = False,
) -> StreamingQuery:
    """S3 whole: each micro-batch is parsed by ``load`` and inserted into ``table`` where absent, then ``steps`` (name, function) run in
    order on the keys that it touched: refresh of rollups, detection, recommendation.

    A ledger in the checkpoint's folder holds the touched keys and each finished step. If the job fails between two steps, the batch begins
    anew with the first step that is not finished, and no report is parsed again. A step that fails before it is marked runs again, so steps must
    leave the same state when repeated; writes by key (``KeyedTable``) do. Batches without rows run no step."""
    ledger = StepLedger(stream.sparkSession, f"{checkpoint}/ledger")

    def step(batch: DataFrame, number: int) -> None:
        if not ledger.done(number, "insert"):
            rows = load(batch).persist()
            try:
                if not rows.isEmpty():
                    table.insert_if_absent(rows, keys)
                ledger.record(number, "insert", rows.select(*touched).distinct())
            finally:
                rows.unpersist()
        found = ledger.keys(number, "insert")
        if found.isEmpty():
            return
        for name, run in steps:
            if not ledger.done(number, name):
                run(found)
                ledger.mark(number, name)

    return _start(stream, step, checkpoint, once)


def diagnosis_steps(
    waits: KeyedTable,
    summary: KeyedTable,
    anomalies: KeyedTable,
    findings: KeyedTable,
    rules: Sequence[rulebook.Rule],
    checks: dict[str, str] | None = None,
    baseline_days: int = 90,
    threshold: float = 1.5,
) -> list[tuple[str, Callable[[DataFrame], None]]]:
    """S3's steps after the insert into ``waits`` (wait event facts): sums by snapshot and event, anomalies (X1) and findings (X4) of the touched
    databases. ``checks``: name of a check -> its column.

    All four tables are partitioned by dbname (or dbname and instance; findings by dbname), so a step reads and rewrites what the touched partitions
    hold and nothing else, and leaves the same rows when repeated."""
    snap = ["dbname", "instance", "begin_snap"]
    own = lambda table, keys: table.read().join(keys, table.partitions, "left_semi")

    def sums(keys: DataFrame) -> DataFrame:
        return own(waits, keys).groupBy(*snap, "event").agg(
            F.sum("waits").alias("total_waits"),
            F.sum("total_wait_time_s").alias("total_wait_time_s"),
            F.avg("avg_wait_ms").alias("avg_wait_ms"),
            F.avg("pct_db_time").alias("pct_db_time"),
        )

    def judged(keys: DataFrame) -> DataFrame:
        d = own(waits, keys)
        named = checks or {"wait_pct": "pct_db_time", "wait_ms": "avg_wait_ms"}
        facts = d.select(*snap, F.col("event").alias("object"), *[F.col(c).cast("double").alias(n) for n, c in named.items()])
        times = d.groupBy(*snap).agg(F.min("snap_time").alias("snap_time"))
        return anomaly.snapshot_anomalies(
            facts.unpivot([*snap, "object"], list(named), "source", "value"), times, baseline_days, threshold
        )

    def advised(keys: DataFrame) -> DataFrame:
        return rulebook.recommendations({"wait": (own(summary, keys), "event")}, rules, ["dbname"])

    return [
        ("refresh", lambda touched: summary.refresh(touched, sums)),
        ("detect", lambda touched: anomalies.refresh(touched, judged)),
        ("recommend", lambda touched: findings.refresh(touched, advised)),
    ]


_POINTS = "hostname {host}, object string, day_no int, n bigint, mean double, m2 double"
_FOUND = "metric_value double, baseline_n bigint, baseline_mean double, baseline_stddev double, fallback boolean, z_score double, severity string"
_SERIES = ["hostname", "object"]


class LearnedHosts:
    """What a stream of host samples has taught: the statistics of every (hostname, object, day), and the newest verdict on each.

    ``path`` is the stream's checkpoint; ``host`` the type of ``hostname``."""

    def __init__(self, spark: SparkSession, path: str, host: str = "string", every: int = 64):
        schema = lambda text: spark.createDataFrame([], text).schema
        points = _POINTS.format(host=host)
        newest = lambda df: newest_by(df, [*_SERIES, "day_no"], F.desc("at_batch"))
        self.points = BatchLog(spark, f"{path}/points", schema(points), lambda df: anomaly.merge_points(df, _SERIES, "day_no"), every)
        verdict = f"hostname {host}, object string, day_no int, at_batch bigint, {_FOUND}"
        self.verdicts = BatchLog(spark, f"{path}/verdicts", schema(verdict), newest, every)

    def anomalies(self) -> DataFrame:
        """The anomalies as of now: those that X2 finds in all samples seen so far."""
        found = self.verdicts.read().where("severity is not null")
        return found.withColumn("day", F.date_from_unix_date("day_no")).drop("day_no", "at_batch")

    def learn(self, samples: DataFrame, batch: int, baseline_days: int = 90, threshold: float = 1.5, min_samples: int = 3) -> None:
        """Adds a batch's samples (hostname, snap_time, object, value) and judges its hosts again from their earliest new day on, since a late day
        is part of later days' baselines. Earlier days can't change: baselines look back only."""
        day = F.unix_date(F.to_date("snap_time")).alias("day_no")
        self.points.append(batch, anomaly.point_stats(samples.select(*_SERIES, day, "value"), _SERIES, "day_no"))
        new = self.points.spark.read.schema(self.points.schema).parquet(f"{self.points.path}/batch={batch}")
        since = new.groupBy(F.col("hostname").alias("__h")).agg(F.min("day_no").alias("since"))
        known = self.points.read(batch).join(since, F.col("hostname").eqNullSafe(F.col("__h"))).drop("__h")
        known = known.withColumn("metric_value", F.coalesce("mean", F.lit(0.0)))
        base = anomaly.rolling_baseline(known, _SERIES, "day_no", baseline_days, min_samples, fallback_by=["hostname"], keep=["since"])
        found = anomaly.detect(base, threshold).where("day_no >= since").drop("since")
        # A row for each day that was judged: one without severity takes back an earlier anomaly.
        judged = known.where("day_no >= since").select(*_SERIES, "day_no").unionByName(found, allowMissingColumns=True)
        rest = [c for c in found.columns if c not in {*_SERIES, "day_no"}]
        verdicts = judged.groupBy(*_SERIES, "day_no").agg(*[F.max(c).alias(c) for c in rest])
        self.verdicts.append(batch, verdicts.withColumn("at_batch", F.lit(batch).cast("long")))


def learning_host_stream(
    stream: DataFrame,
    checkpoint: str,
    baseline_days: int = 90,
    threshold: float = 1.5,
    min_samples: int = 3,
    once: bool = False,
    every: int = 64,
) -> StreamingQuery:
    """S4 with baselines that learn: each micro-batch adds to the stored statistics and is judged by what the samples of all batches so far
    say. After each batch ``LearnedHosts(...).anomalies()`` equals X2 over the same samples, in whatever order they came.

    State is one row a (hostname, object, day), not the samples. ``stream``: hostname, snap_time, object, value."""
    learned = LearnedHosts(stream.sparkSession, checkpoint, stream.schema["hostname"].dataType.simpleString(), every)

    def step(batch: DataFrame, number: int) -> None:
        learned.learn(batch, number, baseline_days, threshold, min_samples)

    return _start(stream, step, checkpoint, once)


def host_anomaly_stream(
    stream: DataFrame, baselines: DataFrame, threshold: float = 1.5, window: str = "1 hour", late: str = "10 minutes"
) -> DataFrame:
    """Windowed means of a sample stream scored against a static baseline table (hostname, object, baseline_mean, baseline_stddev).

    ``stream``: hostname, snap_time, object, value. A window comes out once, when the watermark has passed it."""
    w = stream.withColumn("snap_time", F.col("snap_time").cast("timestamp")).withWatermark("snap_time", late).groupBy(
        "hostname", "object", F.window("snap_time", window).alias("w")
    ).agg(F.avg("value").alias("metric_value"))
    j = w.join(baselines, ["hostname", "object"]).withColumn("z_score", z_score("metric_value", "baseline_mean", "baseline_stddev"))
    return j.withColumn("severity", z_severity("z_score", threshold)).where("severity is not null").select(
        "hostname", "object", F.col("w.start").alias("window_start"), "metric_value", "z_score", "severity"
    )
