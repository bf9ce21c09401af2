"""Filters, series, searches and pickers (P1-P13), top-k and set operations (K, U), keyed newest rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import severity_order


def snap_range_filter(df: DataFrame, dbname, instance, first: int | None, last: int | None) -> DataFrame:
    """An empty parameter gives no rows."""
    if dbname in (None, "") or instance in (None, "") or first is None or last is None:
        return df.where(F.lit(False))
    return df.where((F.col("dbname") == dbname) & (F.col("instance") == instance) & F.col("begin_snap").between(first, last))


def metric_series(
    df: DataFrame, name: str, wanted: Sequence[str] | None, value: str, above: float | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Long time series of the named metrics, optionally above a value."""
    out = df if wanted is None else df.where(F.col(name).isin(*wanted))
    out = out if above is None else out.where(F.col(value) > above)
    return out.select("snap_time", *keys, F.col(name).alias("metric"), F.col(value).alias("value")).orderBy("snap_time", "metric")


def host_series(df: DataFrame, hosts: Sequence | None, start: str, end: str, without: Sequence[str] = ()) -> DataFrame:
    """Samples of hosts (None: all) in a closed date range, without some objects."""
    out = df.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = out if hosts is None else out.where(F.col("hostname").isin(*hosts))
    return out.where(~F.col("object").isin(*without)) if without else out


def optional_filter(df: DataFrame, **wanted) -> DataFrame:
    """A filter for every parameter that is given."""
    for c, v in wanted.items():
        if v not in (None, ""):
            df = df.where(F.col(c) == v)
    return df


def picker_values(df: DataFrame, column: str) -> DataFrame:
    """An empty choice and the distinct values."""
    v = F.col(column).cast("string").alias("choice")
    return df.sparkSession.range(1).select(F.lit("").alias("choice")).unionAll(df.select(v).where(F.col(column).isNotNull()).distinct())


def contains(text: Column, query: str) -> Column:
    """Case does not count; ``%`` and ``_`` of the query are plain characters."""
    plain = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return text.ilike(f"%{plain}%")


def text_search(df: DataFrame, column: str, query: str) -> DataFrame:
    """P5, P7 as a scan; ``textindex`` has the search by trigrams."""
    return df.where(contains(F.col(column), query))


def newest_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; end the order with a tie-breaker."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def newest_values(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """W2 and J8 as an aggregate: no sort, and combined before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, "__r.*")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """K1"""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """K2: adds ``rank_in_group``."""
    return df.withColumn("rank_in_group", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank_in_group") <= k)


def findings_list(findings: DataFrame, k: int = 20, **scope) -> DataFrame:
    """P10: findings of one scope, largest deviation first."""
    return top_k(optional_filter(findings, **scope), k, F.abs("z_score").desc(), F.col("object_name"))


def by_severity(findings: DataFrame, *more: Column) -> DataFrame:
    """K3"""
    return findings.orderBy(severity_order("severity"), *more)


def id_search(df: DataFrame, key: str, value, newest: str, columns: Sequence[str]) -> DataFrame:
    """The newest row of one id."""
    return newest_values(df.where(F.col(key) == value), [key], F.col(newest), list(columns))


def text_viewer(texts: DataFrame, key: str, text: str, snap: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Each id's newest text within a snapshot range, runs of blanks made one."""
    d = texts if lo is None else texts.where(F.col(snap) >= lo)
    d = d if hi is None else d.where(F.col(snap) <= hi)
    return newest_values(d, [key], F.col(snap), [snap, text]).withColumn(text, F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def tag_list(tags: DataFrame, newest: str, tie: str, k: int = 50, **filters) -> DataFrame:
    """The newest tags."""
    return top_k(optional_filter(tags, **filters), k, F.desc(newest), F.col(tie))


def plan_get(steps: DataFrame, key: str, value, step: str) -> DataFrame:
    """The steps of one plan, in order."""
    return steps.where(F.col(key) == value).orderBy(step)


def feedback_history(
    feedback: DataFrame, status: str, newest: str, tie: str, k: int = 100, among: Sequence[str] | None = None
) -> DataFrame:
    """Recent feedback whose status is among the given ones, the newest first."""
    d = feedback if among is None else feedback.where(F.col(status).isin(*among))
    return top_k(d, k, F.desc(newest), F.col(tie))


def socket_ratios(sockets: DataFrame) -> DataFrame:
    """Sockets that are neither TCP nor UDP, and waiting ones in percent of TCP (NULL without any)."""
    waiting = F.col("tcp_tw") / F.nullif("tcpsck", F.lit(0.0)) * 100
    return sockets.withColumns({"other_sockets": F.col("totsck") - F.col("tcpsck") - F.col("udpsck"), "tw_pct": waiting})


def advisory_curve(advisory: DataFrame, dbname, instance, begin_snap: int, size: str, estimates: Sequence[str]) -> DataFrame:
    """Size against estimates for one snapshot, in order of size."""
    own = advisory.where((F.col("dbname") == dbname) & (F.col("instance") == instance) & (F.col("begin_snap") == begin_snap))
    return own.select(size, *estimates).orderBy(size, *estimates)


def topn_semi(df: DataFrame, entity: str, value: str, k: int) -> DataFrame:
    """The rows of the k entities with the largest mean. The k rows' size is known to Spark, which decides about broadcasting them."""
    top = top_k(df.groupBy(entity).agg(F.avg(value).alias("__m")), k, F.desc("__m"), F.col(entity))
    return df.join(top, entity, "left_semi")


def header_carry(mark: Column, by: Sequence[str], order: str) -> Column:
    """The last mark so far (rows whose mark is NULL have none of their own)."""
    return F.last(mark, ignorenulls=True).over(W.partitionBy(*by).orderBy(order))


def occurrence_number(by: Sequence[str], order: str) -> Column:
    """Which occurrence of equal ``by`` a row is, from 1."""
    return F.row_number().over(W.partitionBy(*by).orderBy(order))


def union_distinct(*parts: DataFrame) -> DataFrame:
    """The distinct rows of all parts, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """U3"""
    return df.select(*columns).distinct()
