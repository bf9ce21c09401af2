"""Aggregations: wait, statement and segment summaries, thresholds, counts and panels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .ranks import exact_percentiles
from .select import top_k

SNAP = ("dbname", "instance", "begin_snap")


def wait_summary(waits: DataFrame, min_pct: float = 5.0, keys: Sequence[str] = (*SNAP, "event")) -> DataFrame:
    """A4, A5: events above ``min_pct`` with time, blended score F11. Works on foreground and background alike."""
    g = waits.where((F.col("pct") > min_pct) & (F.col("total_wait_time_s") > 0)).groupBy(*keys)
    out = g.agg(
        F.sum("waits").alias("waits"),
        F.sum("total_wait_time_s").alias("total_wait_time_s"),
        F.avg("avg_wait_ms").alias("avg_wait_ms"),
        F.max("avg_wait_ms").alias("max_wait_ms"),
        F.min("avg_wait_ms").alias("min_wait_ms"),
        F.avg("pct").alias("avg_pct"),
    )
    return out.withColumn("score", S.wait_blend("avg_pct", "total_wait_time_s", "avg_wait_ms", 12))


def event_dimension(facts: DataFrame, classes: DataFrame, event: str = "event") -> DataFrame:
    """Left join on the trimmed lower-case name; unknown events are of class Other. ``classes`` is a small dimension: Spark's size
    check decides on a broadcast."""
    dim = classes.select(F.trim(F.lower("event")).alias("__e"), "wait_class").groupBy("__e").agg(F.min("wait_class").alias("wait_class"))
    return facts.join(
        dim, F.trim(F.lower(F.col(event))) == F.col("__e"), "left"
    ).drop("__e").withColumn("wait_class", F.coalesce("wait_class", F.lit("Other")))


def wait_event_summary(waits: DataFrame, classes: DataFrame, keys: Sequence[str] = (*SNAP, "event")) -> DataFrame:
    """Every event with its class and the 1-5 score F10."""
    out = waits.groupBy(*keys).agg(
        F.sum("waits").alias("waits"),
        F.sum("total_wait_time_s").alias("total_wait_time_s"),
        F.avg("avg_wait_ms").alias("avg_wait_ms"),
        F.avg("pct").alias("avg_pct"),
    )
    return event_dimension(out, classes).withColumn("score", S.wait_score("avg_pct"))


def wait_summary_all(foreground: DataFrame, background: DataFrame, classes: DataFrame) -> DataFrame:
    """Both scopes together with the blend F12."""
    both = foreground.withColumn("scope", F.lit("foreground")).unionByName(background.withColumn("scope", F.lit("background")))
    out = wait_event_summary(both, classes, (*SNAP, "scope", "event")).drop("score")
    return out.withColumn("score", S.wait_summary_blend("avg_pct", "total_wait_time_s", "avg_wait_ms", 12))


def melt(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide facts to (keys, metric, value); NULL values are dropped."""
    return df.unpivot(list(keys), list(metrics), "metric", "value").where("value is not null")


def star_of_aggregates(
    long: DataFrame, keys: Sequence[str], metrics: Sequence[str], driving: str | None = None, how: str = "avg"
) -> DataFrame:
    """Facts aggregated to one key and put side by side: one union and one pivot in place of a chain of joins, so one shuffle.
    Keys without a row of the ``driving`` metric go, as they would in left joins from it."""
    agg = {"avg": F.avg, "sum": F.sum, "max": F.max}[how]
    out = long.groupBy(*keys).agg(
        *[agg(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics],
        *([F.count_if(F.col("metric") == driving).alias("__driving")] if driving else []),
    )
    return out.where("__driving > 0").drop("__driving") if driving else out


def star_by_joins(facts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """J2 as the chain of left joins: each fact (keys, value) averaged to the key first. Same result as the pivot form."""
    names = list(facts)
    out = facts[names[0]].groupBy(*keys).agg(F.avg("value").alias(names[0]))
    for n in names[1:]:
        out = out.join(facts[n].groupBy(*keys).agg(F.avg("value").alias(n)), list(keys), "left")
    return out


def sql_summary(statements: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """Statements by snapshot with the score F13. ``metrics``: score metric -> column."""
    long = melt(
        statements.select(*SNAP, "sql_id", *[F.col(c).cast("double").alias(m) for m, c in metrics.items()]),
        (*SNAP, "sql_id"),
        list(metrics),
    )
    return star_of_aggregates(
        long, (*SNAP, "sql_id"), list(metrics), driving="elapsed"
    ).withColumn("score", S.sql_score({m: m for m in metrics}, 12))


def segment_summary(long: DataFrame, metrics: Sequence[str], driving: str) -> DataFrame:
    """A10, entity grain: objects by snapshot with the sum score F15."""
    keys = (*SNAP, "object_name")
    return star_of_aggregates(long, keys, metrics, driving).withColumn("score", S.segment_score_sum(list(metrics), 12))


def segment_summary_coarse(long: DataFrame, metrics: Sequence[str], driving: str) -> DataFrame:
    """The driving metric by object, all others at snapshot grain, with the weighted score F14."""
    objects = long.where(F.col("metric") == driving).groupBy(*SNAP, "object_name").agg(F.avg("value").alias(driving))
    others = [m for m in metrics if m != driving]
    # Means over whole snapshots: sums are exact in the input's first six digits, so their order doesn't show.
    mean = lambda m: F.sum(
        F.when(F.col("metric") == m, F.col("value").cast("decimal(28,6)"))
    ).cast("double") / F.nullif(F.count(F.when(F.col("metric") == m, F.col("value"))), F.lit(0))
    snaps = long.where(F.col("metric") != driving).groupBy(*SNAP).agg(*[mean(m).alias(m) for m in others])
    return objects.join(snaps, list(SNAP), "left").withColumn("score", S.segment_score_weighted(list(metrics), 12))


def score_by_snap(scored: DataFrame, entity: str) -> DataFrame:
    """Mean score of each entity in each snapshot, keys in lower case."""
    return scored.groupBy(
        "begin_snap", F.lower(F.col("dbname").cast("string")).alias("dbname"), F.lower(F.col(entity).cast("string")).alias("entity")
    ).agg(F.avg("score").alias("score"))


def share_of_total(waits: DataFrame, keys: Sequence[str] = ("dbname", "instance")) -> DataFrame:
    """An event's part of all pct in the snapshots where it occurs."""
    per = waits.groupBy(*keys, "begin_snap", "event").agg(F.sum("pct").alias("pct"))
    total = waits.groupBy(*keys, "begin_snap").agg(F.sum("pct").alias("all_pct"))
    return per.join(total, [*keys, "begin_snap"]).groupBy(*keys, "event").agg(
        (100 * F.sum("pct") / F.nullif(F.sum("all_pct"), F.lit(0))).alias("share")
    )


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    """NULL where there is none of a severity."""
    n = lambda s: F.nullif(F.count_if(F.col("severity") == s), F.lit(0)).alias(s)
    return findings.groupBy(*by).agg(n("critical"), n("alert"), n("warning"), F.count("*").alias("findings"))


def distinct_counts(findings: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values of each column and the largest deviation."""
    return findings.groupBy(*by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns], F.max(F.abs("z_score")).alias("max_abs_z"))


def repeat_offenders(findings: DataFrame, by: Sequence[str], k: int = 20) -> DataFrame:
    """A15"""
    out = findings.groupBy(*by).agg(
        F.count("*").alias("times"),
        F.max(F.abs("z_score")).alias("max_abs_z"),
        F.avg("metric_value").alias("avg_value"),
        F.avg("baseline_mean").alias("avg_baseline"),
    )
    return top_k(out, k, F.desc("times"), F.desc("max_abs_z"), *[F.col(c) for c in by])


def top_waits(waits: DataFrame, k: int = 10) -> DataFrame:
    """Events by mean share, NULLs last."""
    out = waits.groupBy("event").agg(
        F.avg("pct").alias("avg_pct"),
        F.avg("avg_wait_ms").alias("avg_ms"),
        F.sum("waits").alias("waits"),
        F.sum("total_wait_time_s").alias("time_s"),
    )
    return top_k(out, k, F.col("avg_pct").desc_nulls_last(), F.col("event"))


def top_sql(statements: DataFrame, k: int = 20) -> DataFrame:
    """Each side is aggregated before anything is joined, so nothing multiplies."""
    out = statements.groupBy("sql_id").agg(
        F.sum("elapsed").alias("elapsed"),
        F.avg("elapsed").alias("avg_elapsed"),
        F.sum("executions").alias("executions"),
        F.sum("cpu").alias("cpu"),
    )
    return top_k(out, k, F.col("elapsed").desc_nulls_last(), F.col("sql_id"))


def top_segments(long: DataFrame, metrics: Sequence[str], k: int = 5) -> DataFrame:
    """The largest objects of every metric at once. An object is one row with the sums of all metrics while it is aggregated, so that a task holds its
    names once and not once a metric."""
    from .select import top_k_per_group

    own = lambda m: F.when(F.col("metric") == m, F.col("value"))
    sums = [F.struct(F.sum(own(m)).alias("total"), F.count(own(m)).alias("n")).alias(f"__{i}") for i, m in enumerate(metrics)]
    bit = reduce(lambda e, i: e.when(F.col("metric") == metrics[i], F.lit(1 << i)), range(1, len(metrics)), F.when(F.col("metric") == metrics[0], F.lit(1)))
    object_ = ["owner", "object_name", "obj_type"]
    wide = long.where(F.col("metric").isin(*metrics)).groupBy(*object_).agg(F.bit_or(bit.cast("bigint")).alias("__has"), *sums)
    rows = F.array(
        *[
            F.when(
                F.col("__has").bitwiseAND(F.lit(1 << i)) != 0,
                F.struct(F.lit(m).alias("metric"), F.col(f"__{i}.total"), (F.col(f"__{i}.total") / F.nullif(F.col(f"__{i}.n"), F.lit(0))).alias("avg_value")),
            )
            for i, m in enumerate(metrics)
        ]
    )
    out = wide.select(*object_, F.explode(F.array_compact(rows)).alias("__m")).select("__m.metric", *object_, "__m.total", "__m.avg_value")
    return top_k_per_group(out, ["metric"], k, F.desc("total"), F.col("owner"), F.col("object_name"))


def average_by(df: DataFrame, key: str, value: str, like: str | None = None) -> DataFrame:
    """Mean by metric, or of the metrics whose name matches."""
    d = df if like is None else df.where(F.col(key).ilike(like))
    return d.groupBy(F.col(key).alias("metric")).agg(F.avg(value).alias("avg_value"))


#: The percentiles that divide scores into traffic lights.
THRESHOLDS = (0.1, 0.4, 0.7, 0.9)


def percentile_thresholds(scored: DataFrame, entity: str, by: Sequence[str] = (), at: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Exact percentiles of the entities' mean scores, by rank selection."""
    means = scored.groupBy(*by, entity).agg(F.avg("score").alias("mean_score"))
    return exact_percentiles(means, by, "mean_score", at)


def device_scorecard(disks: DataFrame) -> DataFrame:
    """Mean and peak of each metric, and the status F19. Needs object, util, await_ms, tps."""
    g = disks.groupBy("hostname", "object").agg(
        *[f(c).alias(f"{n}_{c}") for c in ("util", "await_ms", "tps") for n, f in (("avg", F.avg), ("peak", F.max))]
    )
    return g.withColumn("status", S.disk_status("avg_util", "avg_await_ms"))


def per_timestamp(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """A23"""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def ordered_bullets(df: DataFrame, keys: Sequence[str], value: str, distinct: bool = False, sep: str = "\n") -> DataFrame:
    """Values joined in order, optionally each once."""
    items = F.sort_array(F.collect_set(value) if distinct else F.collect_list(value))
    return df.groupBy(*keys).agg(F.array_join(items, sep).alias("bullets"))


def conditional_pivot(df: DataFrame, keys: Sequence[str], name: str, value: str, patterns: dict[str, str]) -> DataFrame:
    """Largest value of the names that match each pattern."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(name).ilike(p), F.col(value))).alias(c) for c, p in patterns.items()])


def metadata_inventory(meta: DataFrame, owners: DataFrame, overdue_days: int = 60) -> DataFrame:
    """Objects and last analysis by owner and type; owners without metadata are ``missing``."""
    g = meta.groupBy("owner", "object_type").agg(F.count("*").alias("objects"), F.min("analysed_days").alias("last_days"))
    out = owners.select("owner").distinct().join(g, "owner", "left")
    status = F.when(F.col("objects").isNull(), "missing").when(F.col("last_days") > overdue_days, "overdue").otherwise("ok")
    return out.withColumn("status", status)


def series_bounds(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A27"""
    return df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def usage_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A28"""
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


def class_rollup(waits: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """Waits and time by class."""
    out = event_dimension(waits, classes).groupBy("wait_class").agg(
        F.sum("waits").alias("waits"), F.sum("total_wait_time_s").alias("time_s"), F.avg("avg_wait_ms").alias("avg_ms")
    )
    return top_k(out, k, F.desc("time_s"), F.col("wait_class"))


def segment_panel(long: DataFrame, metric: str, at_least: float, k: int) -> DataFrame:
    """Objects with a large enough value, ranked by the maximum where there is one snapshot, else by the mean."""
    d = long.where((F.col("metric") == metric) & (F.col("value") >= at_least))
    out = d.groupBy("owner", "object_name").agg(
        F.countDistinct("begin_snap").alias("snaps"), F.max("value").alias("top"), F.avg("value").alias("mean")
    )
    out = out.withColumn("rank_value", F.when(F.col("snaps") == 1, F.col("top")).otherwise(F.col("mean")))
    return top_k(out, k, F.desc("rank_value"), F.col("owner"), F.col("object_name"))
