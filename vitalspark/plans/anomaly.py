"""Rolling-baseline anomalies of every database, host, snapshot and metric in one job.

The facts are reduced to one row a point (snapshot, day or window) and series, with count, mean and sum of squared deviations. A range window over
those few rows merges the baselines of all points at once (parallel-variance formula around the series' mean, so large values lose no
digits); no point loops over its history and no raw row is read twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import z_score, z_severity


def point_stats(facts: DataFrame, series: Sequence[str], point: str, value: str = "value") -> DataFrame:
    """A3 and the partial sums of A1: one row a (series, point); NULL values count as 0 in ``metric_value`` only where nothing else is there."""
    return facts.groupBy(*series, point).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("m2"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("metric_value"),
    )


def point_stats_of_columns(facts: DataFrame, series: Sequence[str], point: str, columns: dict[str, str]) -> DataFrame:
    """``point_stats`` of several columns (name of the check -> column) with the name as ``source``: the facts are aggregated as they are, one row a key, and
    only that row is taken apart by column."""
    key = [*series, point]
    each = lambda c: F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("m2"), F.coalesce(F.avg(c), F.lit(0.0)).alias("metric_value")
    )
    wide = facts.groupBy(*key).agg(*[each(F.col(c).cast("double")).alias(f"__{i}") for i, c in enumerate(columns.values())])
    rows = F.array(*[F.struct(F.lit(name).alias("source"), f"__{i}.*") for i, name in enumerate(columns)])
    return wide.select(*key, F.inline(rows))


def merge_points(parts: DataFrame, series: Sequence[str], point: str) -> DataFrame:
    """Partial statistics (``point_stats``) of one point, from several loads, as one row; the same as of all its values at once."""
    key = [*series, point]
    whole = W.partitionBy(*key)
    center = F.sum(F.col("n") * F.col("mean")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0))
    off = F.col("mean") - F.col("center")
    return parts.withColumn("center", center).groupBy(*key).agg(
        F.sum("n").alias("n"), F.max("center").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2")
    )


#: The relative error of a rounded sum, for each of its terms.
ROUNDING = 4.5e-16


def _with_merged(d: DataFrame, windows: dict[str, W]) -> DataFrame:
    """Adds (count, mean, stddev_samp) of the points in each window as its prefix + n, mean, sd. ``center`` is the series' mean.

    The windows' sums are columns of their own first, all from one pass: Spark evaluates a window expression once for each place where it stands. A
    spread within the rounding error of these sums is 0: else a metric that never moved would have a baseline of 1e-8 or so, and every first move would
    be critical."""
    gap = F.col("mean") - F.col("center")
    sums, out = {}, {}
    for p, window in windows.items():
        sums |= {
            f"{p}n": F.coalesce(F.sum("n").over(window), F.lit(0)),
            f"{p}off": F.sum(F.col("n") * gap).over(window),
            f"{p}square": F.sum(F.col("m2") + F.col("n") * gap * gap).over(window),
            f"{p}points": F.count("mean").over(window),
        }
        n, off, square, points = (F.col(f"{p}{c}") for c in ("n", "off", "square", "points"))
        size = F.when(n > 0, n)
        mean, spread = F.col("center") + off / size, square - off * off / size
        ulp = 4 * ROUNDING * F.abs(mean)
        noise = square * points * ROUNDING + n * ulp * ulp
        out |= {f"{p}mean": mean, f"{p}sd": F.when(n > 1, F.when(spread > noise, F.sqrt(spread / (n - 1))).otherwise(0.0))}
    return d.withColumns(sums).withColumns(out)


def rolling_baseline(
    stats: DataFrame,
    series: Sequence[str],
    axis: str,
    span: int,
    min_samples: int = 3,
    fallback_by: Sequence[str] | None = None,
    fallback_samples: int = 2,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Each point with the baseline of the points in ``[axis - span, axis - 1]`` of its series.

    ``axis`` is a whole number (day, snapshot or second); a NULL axis has no primary baseline. With ``fallback_by`` the rule of A2 holds: where
    in a group (say: database, snapshot, check) no series reaches ``min_samples``, all earlier points with ``fallback_samples`` rows count.
    Points without a baseline are dropped. ``keep``: other columns of the points to be passed on."""
    whole = W.partitionBy(*series)
    d = stats.withColumn("center", F.sum(F.col("n") * F.col("mean")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0)))
    order = whole.orderBy(axis)
    windows = {"b_": order.rangeBetween(-span, -1)}
    if fallback_by is not None:
        windows["f_"] = order.rangeBetween(W.unboundedPreceding, -1)
    d = _with_merged(d, windows)
    if fallback_by is not None:
        # A point with a primary baseline makes its group primary; one without needs the fallback or nothing. So each takes one baseline along.
        own = F.col("b_n") >= min_samples
        d = d.withColumns({"own_": own} | {f"{c}_": F.when(own, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}")) for c in ("n", "mean", "sd")})
        d = d.where(F.col("own_") | (F.col("n_") >= fallback_samples)).select(*series, axis, *keep, "metric_value", "own_", "n_", "mean_", "sd_")
        d = d.withColumn("primary_", F.max("own_").over(W.partitionBy(*fallback_by, axis))).where(F.col("own_") | ~F.col("primary_"))
        d = d.withColumn("fallback", ~F.col("primary_"))
        out = d.select(
            *series,
            axis,
            *keep,
            "metric_value",
            F.col("n_").alias("baseline_n"),
            F.col("mean_").alias("baseline_mean"),
            F.col("sd_").alias("baseline_stddev"),
            "fallback",
        )
    else:
        out = d.where(F.col("b_n") >= min_samples).select(
            *series,
            axis,
            *keep,
            "metric_value",
            F.col("b_n").alias("baseline_n"),
            F.col("b_mean").alias("baseline_mean"),
            F.col("b_sd").alias("baseline_stddev"),
        )
    return out


def detect(baselines: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Scored points at or above the threshold."""
    scored = baselines.withColumn("z_score", z_score("metric_value", "baseline_mean", "baseline_stddev"))
    return scored.withColumn("severity", z_severity("z_score", threshold)).where("severity is not null")


def host_anomalies(
    samples: DataFrame, baseline_days: int = 90, threshold: float = 1.5, min_samples: int = 3, hours: int | None = None
) -> DataFrame:
    """Every host, day and check. ``samples``: hostname, day, object, value (melted; ``object`` names check and device).

    ``hours`` (with snap_time): a day's own value is the mean of the closed window of so many hours from its midnight; baselines are of whole days."""
    series = ["hostname", "object"]
    stats = point_stats(samples.withColumn("day_no", F.unix_date("day")), series, "day_no")
    if hours:
        w = hour_windows(samples, hours).groupBy(*series, F.unix_date("day").alias("day_no")).agg(
            F.coalesce(F.avg("value"), F.lit(0.0)).alias("metric_value")
        )
        stats = w.join(stats.drop("metric_value"), [*series, "day_no"], "left").fillna(0, ["n", "mean", "m2"])
    found = detect(rolling_baseline(stats, series, "day_no", baseline_days, min_samples, fallback_by=["hostname"]), threshold)
    return found.withColumn("day", F.date_from_unix_date("day_no")).drop("day_no")


SNAP, SNAP_SERIES = ["dbname", "instance", "begin_snap"], ["dbname", "instance", "source", "object"]


def snapshot_anomalies(
    facts: DataFrame, times: DataFrame, baseline_days: int = 90, threshold: float = 1.5, min_samples: int = 3
) -> DataFrame:
    """Every database, instance, snapshot and check. ``facts``: dbname, instance, begin_snap, source, object, value (melted);
    ``times``: dbname, instance, begin_snap, snap_time, one row a snapshot.

    A baseline goes back ``baseline_days`` in time from the snapshot, whatever the spacing of the snapshots; snapshots of one second don't count
    for each other."""
    return snapshot_point_anomalies(point_stats(facts, SNAP_SERIES, "begin_snap"), times, baseline_days, threshold, min_samples)


def snapshot_point_anomalies(
    stats: DataFrame, times: DataFrame, baseline_days: int = 90, threshold: float = 1.5, min_samples: int = 3
) -> DataFrame:
    """``snapshot_anomalies`` from facts that are reduced to points already: ``point_stats`` of dbname, instance, source, object by begin_snap."""
    at = times.select(*SNAP, F.unix_seconds(F.col("snap_time").cast("timestamp")).alias("second"))
    found = rolling_baseline(
        stats.join(at, SNAP), SNAP_SERIES, "second", baseline_days * 86_400, min_samples, fallback_by=["dbname", "instance", "source"], keep=["begin_snap"]
    )
    return detect(found, threshold).drop("second")


def eligible_snapshots(snaps: DataFrame, min_prior: int) -> DataFrame:
    """Snapshots with at least ``min_prior`` earlier ones of their instance (snapshots are counted, not rows)."""
    d = snaps.select("dbname", "instance", "begin_snap").distinct()
    return d.withColumn(
        "prior", F.dense_rank().over(W.partitionBy("dbname", "instance").orderBy("begin_snap")) - 1
    ).where(F.col("prior") >= min_prior)


def hour_windows(samples: DataFrame, hours: int = 25) -> DataFrame:
    """X2's closed windows of ``hours`` from each midnight: days overlap by the hours beyond 24, so a sample may count in two."""
    days = -(-hours // 24)
    at = F.explode(F.sequence(F.lit(0), F.lit(days - 1)))
    d = samples.withColumn("__back", at).withColumn("day", F.date_sub(F.to_date("snap_time"), F.col("__back")))
    start = F.col("day").cast("timestamp_ntz")
    return d.where(F.col("snap_time") <= start + F.make_dt_interval(hours=F.lit(hours))).drop("__back")
