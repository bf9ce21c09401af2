"""Host overview (X11), feedback learnings (X16), parse hot spots (X17), statement scorecard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import select
from ..operators.ranks import exact_percentiles


def host_overview(samples: DataFrame, start: str, end: str, busiest: int = 2) -> DataFrame:
    """X11: all panels of every host in one aggregate, percentiles by rank selection: (hostname, object, samples, avg, peak, p95, hot_hours) and whether the object is among the
    host's busiest. ``samples``: hostname, snap_time, day, object, value."""
    d = samples.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    # Means are of exact sums where all values fit: they don't hang on the order of rows.
    exact = F.col("value").try_cast("decimal(28,9)")
    mean = F.when(F.count(exact) == F.count("value"), F.try_sum(exact).cast("double") / F.count(exact))
    g = d.groupBy("hostname", "object").agg(
        F.count("*").alias("samples"),
        F.coalesce(mean, F.avg("value")).alias("avg_value"),
        F.max("value").alias("peak"),
        F.countDistinct(F.date_trunc("hour", "snap_time")).alias("hours"),
    )
    p95 = exact_percentiles(d, ["hostname", "object"], "value", [0.95])
    same = F.col("hostname").eqNullSafe(F.col("h")) & F.col("object").eqNullSafe(F.col("o"))
    g = g.join(p95.withColumnsRenamed({"hostname": "h", "object": "o"}), same, "left").drop("h", "o")
    ranked = select.top_k_per_group(g, ["hostname"], 1 << 30, F.desc("avg_value"), F.col("object"))
    return ranked.withColumn("busy", F.col("rank_in_group") <= busiest).drop("rank_in_group")


def host_timeline(samples: DataFrame, start: str, end: str, busiest: int = 2, unit: str = "hour") -> DataFrame:
    """X11, the panels over time: the busiest objects of every host, one row a (host, object, time), with samples, mean, peak, the change of the
    mean since the row before, and the share of the object's own highest mean. One aggregate of the samples; ranks are of its rows."""
    d = select.host_series(samples, None, start, end)
    g = d.groupBy("hostname", "object", F.date_trunc(unit, "snap_time").alias("at"))
    g = g.agg(
        F.count("*").alias("samples"), F.sum("value").alias("total"), F.max("value").alias("peak")
    ).withColumn("mean", F.col("total") / F.col("samples"))
    means = g.groupBy("hostname", "object").agg((F.sum("total") / F.sum("samples")).alias("whole"))
    busy = select.top_k_per_group(means, ["hostname"], busiest, F.desc("whole"), F.col("object"))
    series = W.partitionBy("hostname", "object")
    out = g.join(busy.select("hostname", "object"), ["hostname", "object"], "left_semi")
    change = F.col("mean") - F.lag("mean").over(series.orderBy("at"))
    share = F.col("mean") / F.nullif(F.max("mean").over(series), F.lit(0.0)) * 100
    return out.select("hostname", "object", "at", "samples", "mean", "peak", change.alias("change"), share.alias("share_pct"))


def feedback_learnings(feedback: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Accepted recommendations by trigger pattern: times accepted and the newest resolution. ``feedback``: trigger_pattern, accepted,
    resolution, at; ``known``: earlier learnings (trigger_pattern, times_accepted, resolution, at), merged in."""
    new = feedback.where("accepted").groupBy("trigger_pattern").agg(
        F.count("*").alias("times_accepted"),
        F.max_by("resolution", F.struct("at", "resolution")).alias("resolution"),
        F.max("at").alias("at"),
    )
    if known is None:
        return new
    return new.unionByName(known).groupBy("trigger_pattern").agg(
        F.sum("times_accepted").alias("times_accepted"),
        F.max_by("resolution", F.struct("at", "resolution")).alias("resolution"),
        F.max("at").alias("at"),
    )


def best_learnings(learnings: DataFrame, pattern: str, k: int = 3) -> DataFrame:
    """The top learnings of a pattern: the exact one first, then those of the same type (the part before ``:``)."""
    kind = pattern.split(":")[0]
    d = learnings.where((F.col("trigger_pattern") == pattern) | F.startswith("trigger_pattern", F.lit(kind + ":")))
    return select.top_k(d, k, F.desc(F.col("trigger_pattern") == pattern), F.desc("times_accepted"), F.col("trigger_pattern"))


def parse_hotspots(parses: DataFrame, texts: DataFrame, more_than: float = 1000, k: int = 10) -> DataFrame:
    """Statements with many parse calls, by executions, with their newest text. The texts are cut to the winners before they are reduced."""
    top = parses.groupBy("sql_id").agg(
        F.sum("parses").alias("parse_calls"), F.sum("executions").alias("executions")
    ).where(F.col("parse_calls") > more_than)
    top = select.top_k(top, k, F.desc("executions"), F.col("sql_id"))
    own = texts.join(top.select("sql_id"), "sql_id", "left_semi")
    return top.join(select.newest_values(own, ["sql_id"], F.col("begin_snap"), ["begin_snap", "sql_text"]), "sql_id", "left")


def sql_scorecard(scored: DataFrame, metrics: Sequence[str], k: int = 10) -> DataFrame:
    """Statements by their largest score, with the components of that snapshot."""
    best = scored.groupBy("sql_id").agg(
        F.max_by(
            F.struct("score", *metrics, "dbname", "instance", "begin_snap"), F.struct("score", "dbname", "instance", "begin_snap")
        ).alias("r")
    ).select("sql_id", "r.*")
    return select.top_k(best, k, F.desc("score"), F.col("sql_id"))
