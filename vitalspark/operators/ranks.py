"""Exact percentiles by rank selection: no group's values are gathered in one buffer or one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written

#: Buckets of one histogram.
BUCKETS = 4096


def exact_percentiles(rows: DataFrame, by: Sequence[str], value: str, at: Sequence[float], buckets: int = BUCKETS, levels: int = 2) -> DataFrame:
    """``by`` and p10, p40, ... for 0.1, 0.4, ... of ``at``: what ``percentile_cont`` gives, from refining histograms.

    Equal values of a group are counted together. Between a group's least and greatest value they are counted in buckets; a bucket is opened only if it
    holds a rank that a percentile needs, at most two for each, and counted anew between its own bounds. What ``levels`` histograms leave open is
    ranked by value. The counted values are written once and read by every pass: means that are summed anew may differ in their last digit, and a
    value just outside the bounds of an earlier pass would shift all ranks. Null values are left out, groups without any other give no row; with an empty ``by`` all rows are one group."""
    ranks = sorted(at)
    weights = rows.where(F.col(value).isNotNull()).groupBy(
        F.struct(*[F.col(c) for c in by]).alias("g") if by else F.lit(0).alias("g"), F.col(value).cast("double").alias("v")
    ).agg(F.count("*").alias("c"))
    weights = written(weights, "ranks")
    whole = weights.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    opened = whole.select("g", "n", F.array(F.struct("lo", "hi", F.lit(0).cast("long").alias("start"))).alias("open"))

    def needed(n: Column, first: Column, count: Column) -> Column:
        """Whether ranks first .. first + count - 1 (from 0) hold one that a percentile needs."""
        inside = lambda r: (r >= first) & (r < first + count)
        out = F.lit(False)
        for p in ranks:
            place = F.lit(float(p)) * (n - 1)
            out = out | inside(F.floor(place)) | inside(F.ceil(place))
        return out

    def inside(ranges: DataFrame) -> DataFrame:
        """The values in open ranges, each with its range; a group's ranges are one short array."""
        j = weights.join(ranges, "g")
        own = F.get(F.filter("open", lambda x: (F.col("v") >= x["lo"]) & (F.col("v") <= x["hi"])), F.lit(0))
        return j.withColumn("r", own).where("r is not null").select("g", "n", "v", "c", "r.lo", "r.hi", "r.start")

    for _ in range(levels):
        span = F.col("hi") - F.col("lo")
        bucket = F.when(span > 0, F.least(F.floor((F.col("v") - F.col("lo")) / span * buckets), F.lit(buckets - 1))).otherwise(0)
        counts = inside(opened).withColumn("b", bucket.cast("int")).groupBy("g", "n", "start", "b").agg(
            F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")
        )
        before = F.sum("c").over(W.partitionBy("g", "start").orderBy("b").rowsBetween(W.unboundedPreceding, -1))
        placed = counts.withColumn("start", F.col("start") + F.coalesce(before, F.lit(0)))
        opened = placed.where(needed(F.col("n"), F.col("start"), F.col("c"))).groupBy("g", "n").agg(F.collect_list(F.struct("lo", "hi", "start")).alias("open"))
    before = F.sum("c").over(W.partitionBy("g", "start").orderBy("v").rowsBetween(W.unboundedPreceding, -1))
    ranked = inside(opened).withColumn("first", F.col("start") + F.coalesce(before, F.lit(0)))
    holds = lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("c"))
    aggregates = []
    for i, p in enumerate(ranks):
        place = F.lit(float(p)) * (F.col("n") - 1)
        aggregates += [F.max(F.when(holds(f(place)), F.col("v"))).alias(f"{side}{i}") for side, f in (("a", F.floor), ("b", F.ceil))]
    found = ranked.groupBy("g", "n").agg(*aggregates)

    def cont(i: int, p: float) -> Column:
        place = F.lit(float(p)) * (F.col("n") - 1)
        share = place - F.floor(place)
        return F.when(F.col(f"a{i}") == F.col(f"b{i}"), F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - share) + F.col(f"b{i}") * share)

    return found.select(*[F.col("g")[c].alias(c) for c in by], *[cont(i, p).alias(f"p{round(p * 100)}") for i, p in enumerate(ranks)])
