"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in ``PARTS`` of the rows is dealt to several tasks. So fewer than PARTS keys are ever split, and their pieces
#: number fewer than 2 * PARTS: that bounds what is broadcast and what is repeated.
PARTS = 1024


def spread_join(
    large: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", parts: int = PARTS
) -> DataFrame:
    """``large`` joined with ``small``, which has one row a key and, in ``count``, the number of large's rows of that key. ``total``: rows of large.

    Rows of a frequent key get a piece number by their hash; small's row of that key is there once for every piece. Nulls in keys match nothing."""
    most = max(1, total // parts)
    pieces = F.ceil(F.col(count) / most).cast("int")
    hot = F.broadcast(small.where(F.col(count) > most).select(*[F.col(k).alias(f"__{k}") for k in keys], pieces.alias("__pieces")))
    own = [F.col(k) == F.col(f"__{k}") for k in keys]
    cond = own[0]
    for c in own[1:]:
        cond = cond & c
    dealt = large.join(hot, cond, "left").withColumn(
        "__piece", F.pmod(F.xxhash64(*large.columns), F.coalesce("__pieces", F.lit(1))).cast("int")
    ).drop(*[f"__{k}" for k in keys], "__pieces")
    each = small.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return dealt.join(each, [*keys, "__piece"], how).drop("__piece")
