"""Period comparison (X7), traffic-light ranking (X8), memory advice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import pct_change
from ..operators import joins, rollups
from ..operators.ranks import exact_percentiles
from ..storage import written


def compare_periods(
    facts: DataFrame, tags: DataFrame, key: Sequence[str], value: Column, at_least: float = 0.0, digits: int = 1
) -> DataFrame:
    """Values of the ``before`` and ``after`` tags with difference and change in percent."""
    out = joins.before_after(joins.tag_join(facts, tags), key, value, at_least)
    return out.withColumn("change_pct", pct_change("before_value", "after_value", digits))


def rag_ranking(scored: DataFrame, entity: str, by: Sequence[str] = ("dbname",)) -> DataFrame:
    """Entities by mean score, coloured by the group's percentiles, with a score normalised between p10 and p90."""
    # Written once: a mean that is itself a percentile must not be compared with one summed in another order.
    means = written(scored.groupBy(*by, entity).agg(F.avg("score").alias("mean_score")), "means")
    p = exact_percentiles(means, by, "mean_score", rollups.THRESHOLDS)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    j = means.join(p.withColumnsRenamed({c: f"__{c}" for c in by}), same)
    m = F.col("mean_score")
    span = F.nullif(F.col("p90") - F.col("p10"), F.lit(0.0))
    norm = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (m - F.col("p10")) / span))
    colour = F.when(m >= F.col("p90"), "red").when(m >= F.col("p70"), "orange").when(m >= F.col("p40"), "yellow").otherwise("green")
    return j.select(*by, entity, "mean_score", F.coalesce(norm, F.lit(0.0)).alias("normalised"), colour.alias("rag"))


def plateau(curve: DataFrame, keys: Sequence[str], size: str, cost: str, gain_below: float = 0.01) -> DataFrame:
    """The first size whose relative gain over the size before is below the limit, one row a key."""
    w = W.partitionBy(*keys).orderBy(size)
    prev = F.lag(cost).over(w)
    d = curve.withColumn("gain", (prev - F.col(cost)) / F.nullif(prev, F.lit(0.0))).where(F.col("gain") < gain_below)
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def confidence(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confidence by number of rows of the group: 70 for one, 85 for up to four, 95 beyond."""
    n = F.count("*").over(W.partitionBy(*by)) if by else df.agg(F.count("*")).scalar()
    return df.withColumn("confidence", F.when(n <= 1, 70).when(n <= 4, 85).otherwise(95))


def memory_advice(curve: DataFrame, os_memory: DataFrame, keys: Sequence[str], gain_below: float = 0.01) -> DataFrame:
    """Plateau against the current size (factor 1) with savings, headroom and a verdict.

    ``curve``: keys, size_mb, factor, db_time, reads; ``os_memory``: keys, free_mb, total_mb."""
    current = curve.where("factor = 1").groupBy(*keys).agg(
        F.min("size_mb").alias("current_mb"), F.min("db_time").alias("current_time"), F.min("reads").alias("current_reads")
    )
    best = plateau(curve, keys, "size_mb", "db_time", gain_below).select(
        *keys, F.col("size_mb").alias("plateau_mb"), F.col("db_time").alias("plateau_time"), F.col("reads").alias("plateau_reads")
    )
    j = current.join(best, list(keys), "left").join(os_memory, list(keys), "left")
    need = F.greatest(F.lit(0.0), F.col("plateau_mb") - F.col("current_mb"))
    out = j.withColumns(
        {
            "need_mb": need,
            "gain_pct": (F.col("current_time") - F.col("plateau_time")) / F.nullif("current_time", F.lit(0.0)) * 100,
            "reads_saved": F.col("current_reads") - F.col("plateau_reads"),
        }
    )
    risk = F.when(F.col("free_mb").isNull(), "unknown").when(
        F.col("need_mb") <= F.col("free_mb") * 0.5, "low"
    ).when(F.col("need_mb") <= F.col("free_mb"), "medium").otherwise("high")
    verdict = F.when(F.col("plateau_mb").isNull(), "still rising").when(F.col("need_mb") == 0, "sufficient").when(
        F.col("need_mb") > F.coalesce("free_mb", F.lit(0.0)), "no room"
    ).otherwise("increase")
    return out.withColumns({"risk": risk, "headroom_mb": F.col("free_mb") - F.col("need_mb"), "verdict": verdict})
