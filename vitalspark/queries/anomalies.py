"""Anomaly queries: A1-A3, W4, W7, X1-X3, and summaries of findings A13-A15, P10, K3."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import rollups, select
from ..plans import anomaly
from . import query

Z = 0.2  # low threshold: the test values vary little


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _host_findings(spark, d, threshold=Z) -> DataFrame:
    return anomaly.host_anomalies(fx.host(spark, d), baseline_days=7, threshold=threshold)


HOST_FINDINGS = """c AS (SELECT hostname, object, day, avg(value) AS metric_value FROM host GROUP BY ALL),
p AS (SELECT c.hostname, c.object, c.day, c.metric_value, count(*) FILTER (WHERE h.day >= c.day - 7) AS n1, avg(h.value) FILTER (WHERE
  h.day >= c.day - 7) AS m1, stddev_samp(h.value) FILTER (WHERE h.day >= c.day - 7) AS s1,
  count(h.value) AS n2, avg(h.value) AS m2, stddev_samp(h.value) AS s2 FROM c
  LEFT JOIN host h ON h.hostname = c.hostname AND h.object = c.object AND h.day < c.day GROUP BY ALL),
q AS (SELECT *, max((n1 >= 3)::INT) OVER (PARTITION BY hostname, day) = 1 AS prim FROM p),
b AS (SELECT hostname, object, day, metric_value, NOT prim AS fallback, CASE WHEN prim THEN n1 ELSE n2 END AS baseline_n, CASE
  WHEN prim THEN m1 ELSE m2 END AS baseline_mean, CASE WHEN prim THEN s1 ELSE s2 END AS baseline_stddev FROM q WHERE CASE
  WHEN prim THEN n1 >= 3 ELSE n2 >= 2 END),
z AS (SELECT *, CASE WHEN coalesce(baseline_stddev, 0) = 0 THEN 0 ELSE (metric_value - baseline_mean) / baseline_stddev END AS z_score
  FROM b),
f AS (SELECT *, CASE WHEN abs(z_score) >= 4 THEN 'critical' WHEN abs(z_score) >= 3 THEN 'alert'
  WHEN abs(z_score) >= 0.2 THEN 'warning' END AS severity FROM z),
findings AS (SELECT * FROM f WHERE severity IS NOT NULL)"""
FINDING = (
    "round(metric_value, 6) AS metric_value, baseline_n::BIGINT AS baseline_n, round(baseline_mean, 6) AS baseline_mean, "
    "round(baseline_stddev, 6) AS baseline_stddev, fallback, round(z_score, 6) AS z_score, severity"
)


@query(fx.sql(f"SELECT hostname, object, day, {FINDING} FROM findings", "host", ctes=HOST_FINDINGS))
def x2_host_anomalies(spark, d):
    return _host_findings(spark, d).select(
        "hostname",
        "object",
        "day",
        *r6("metric_value"),
        "baseline_n",
        *r6("baseline_mean", "baseline_stddev"),
        "fallback",
        *r6("z_score"),
        "severity",
    )


#: Checks of snapshots: two of waits by event, two of statements, two of segments; the days that a baseline goes back.
BACK = 40
FACTS = """facts AS (SELECT dbname::VARCHAR AS dbname, instance::VARCHAR AS instance, begin_snap, 'wait_pct' AS source, event AS object,
  pct AS value FROM wait
 UNION ALL SELECT dbname::VARCHAR, instance::VARCHAR, begin_snap, 'wait_ms', event, avg_wait_ms FROM wait UNION ALL
  SELECT dbname, instance, begin_snap, 'sql_elapsed', sql_id::VARCHAR, floor(elapsed) FROM stmt
 UNION ALL SELECT dbname, instance, begin_snap, 'sql_cpu', sql_id::VARCHAR, floor(cpu) FROM stmt
 UNION ALL SELECT dbname, instance, begin_snap, metric, owner, floor(value) FROM seg WHERE metric IN ('logical_reads', 'physical_reads')),
t AS (SELECT dbname, instance, begin_snap, floor(epoch(min(snap_time)))::BIGINT AS sec
  FROM (SELECT dbname::VARCHAR AS dbname, instance::VARCHAR AS instance, begin_snap, snap_time::TIMESTAMP AS snap_time FROM wait
 UNION ALL SELECT dbname, instance, begin_snap, snap_time::TIMESTAMP FROM stmt) GROUP BY ALL),"""
SNAP_FINDINGS = f"""h AS (SELECT dbname, instance, source, object, sec, value FROM facts JOIN t USING (dbname, instance, begin_snap)),
c AS (SELECT dbname, instance, source, object, begin_snap, sec, coalesce(avg(value), 0) AS metric_value FROM facts
  JOIN t USING (dbname, instance, begin_snap) GROUP BY ALL),
p AS (SELECT c.*, count(h.value) FILTER (WHERE h.sec >= c.sec - {BACK} * 86400) AS n1, avg(h.value) FILTER (WHERE h.sec >= c.sec - {BACK}
  * 86400) AS m1, stddev_samp(h.value) FILTER (WHERE h.sec >= c.sec - {BACK} * 86400) AS s1,
  count(h.value) AS n2, avg(h.value) AS m2, stddev_samp(h.value) AS s2 FROM c
  LEFT JOIN h ON h.dbname = c.dbname AND h.instance = c.instance AND h.source = c.source AND h.object = c.object AND h.sec < c.sec
  GROUP BY ALL),
o AS (SELECT *, max((n1 >= 3)::INT) OVER (PARTITION BY dbname, instance, source, sec) = 1 AS prim FROM p),
m AS (SELECT dbname, instance, source, object, begin_snap, metric_value, NOT prim AS fallback, CASE
  WHEN prim THEN n1 ELSE n2 END AS baseline_n, CASE WHEN prim THEN m1 ELSE m2 END AS baseline_mean, CASE
  WHEN prim THEN s1 ELSE s2 END AS baseline_stddev
  FROM o WHERE CASE WHEN prim THEN n1 >= 3 ELSE n2 >= 2 END),
z AS (SELECT *, CASE WHEN coalesce(baseline_stddev, 0) = 0 THEN 0 ELSE (metric_value - baseline_mean) / baseline_stddev END AS z_score
  FROM m),
f AS (SELECT *, CASE WHEN abs(z_score) >= 4 THEN 'critical' WHEN abs(z_score) >= 3 THEN 'alert'
  WHEN abs(z_score) >= 1.5 THEN 'warning' END AS severity FROM z),
findings AS (SELECT * FROM f WHERE severity IS NOT NULL)"""


def _snapshot_findings(spark, d) -> DataFrame:
    """Wait events, statements and segments, each reduced to its points as it is and then put together as (source, object)."""
    key = ["dbname", "instance", "begin_snap"]
    whole = lambda c: F.floor(c).alias(c)  # noqa: E731  whole units, so that means of equal sums don't end on a half of a rounded digit
    reads = ("logical_reads", "physical_reads")
    w, s, g = fx.wait(spark, d), fx.stmt(spark, d).withColumns({c: whole(c) for c in ("elapsed", "cpu")}), fx.seg(spark, d, reads)
    checks = lambda df, obj, of: anomaly.point_stats_of_columns(
        df, ["dbname", "instance", obj], "begin_snap", {n: c for c, n in of.items()}
    ).withColumnRenamed(obj, "object")
    segments = g.where(F.col("metric").isin(*reads)).select(
        *key, F.col("owner").alias("object"), F.col("metric").alias("source"), F.floor("value").cast("double").alias("value")
    )
    points = [
        checks(w, "event", {"pct": "wait_pct", "avg_wait_ms": "wait_ms"}),
        checks(s, "sql_id", {"elapsed": "sql_elapsed", "cpu": "sql_cpu"}),
        anomaly.point_stats(segments, anomaly.SNAP_SERIES, "begin_snap"),
    ]
    text = lambda df, *cols: df.withColumns({c: F.col(c).cast("string") for c in cols})  # noqa: E731  keys are text only once they are few
    stats = reduce(lambda a, b: a.unionByName(b), [text(p, "dbname", "instance", "object") for p in points])
    first = lambda df: text(df.groupBy(*key).agg(F.min(F.col("snap_time").cast("timestamp")).alias("snap_time")), "dbname", "instance")
    times = first(w).union(first(s)).groupBy(*key).agg(F.min("snap_time").alias("snap_time"))
    return anomaly.snapshot_point_anomalies(stats, times, BACK, 1.5)


_SNAP_COLUMNS = (
    "dbname, instance, begin_snap, source, object, round(metric_value, 6) AS metric_value, baseline_n::BIGINT AS baseline_n, "
    "round(baseline_mean, 6) AS baseline_mean, round(baseline_stddev, 6) AS baseline_stddev, fallback, round(z_score, 6) AS z_score, "
    "severity"
)


@query(fx.sql(f"SELECT {_SNAP_COLUMNS} FROM findings", "wait", "stmt", "seg", ctes=FACTS + SNAP_FINDINGS))
def x1_snapshot_anomalies(spark, d):
    return _snapshot_findings(spark, d).select(
        "dbname",
        "instance",
        "begin_snap",
        "source",
        "object",
        *r6("metric_value"),
        "baseline_n",
        *r6("baseline_mean", "baseline_stddev"),
        "fallback",
        *r6("z_score"),
        "severity",
    )


#: Hosts with closed windows of 25 hours as a day's own value.
_HOURS = "own AS (SELECT *, day AS wday FROM host UNION ALL SELECT *, day - 1 FROM host WHERE snap_time <= (day + INTERVAL 1 HOUR)), "
HOST_25 = _HOURS + HOST_FINDINGS.replace(
    "c AS (SELECT hostname, object, day, avg(value) AS metric_value FROM host GROUP BY ALL)",
    "c AS (SELECT hostname, object, wday AS day, avg(value) AS metric_value FROM own GROUP BY ALL)",
)


@query(fx.sql("""SELECT 'snapshot' AS scope, count(*) AS findings, round(max(abs(z_score)), 3) AS max_abs_z FROM findings UNION ALL
  SELECT 'host', count(*), round(max(abs(z_score)), 3) FROM hf""", "wait", "stmt", "seg", "host",
              ctes=FACTS + SNAP_FINDINGS + ", " + "hf AS (WITH " + HOST_25 + " SELECT * FROM findings)"))
def x3_backfill(spark, d):
    one = lambda f, s: f.agg(
        F.lit(s).alias("scope"), F.count("*").alias("findings"), F.round(F.max(F.abs("z_score")), 3).alias("max_abs_z")
    )
    hosts = anomaly.host_anomalies(fx.host(spark, d), baseline_days=7, threshold=Z, hours=25)
    return one(_snapshot_findings(spark, d), "snapshot").union(one(hosts, "host"))


@query(fx.sql("""SELECT c.hostname, c.object, c.day, count(*)::BIGINT AS baseline_n, round(avg(h.value), 6) AS baseline_mean,
  round(stddev_samp(h.value), 6) AS baseline_stddev FROM (SELECT DISTINCT hostname, object, day FROM host) c
  JOIN host h ON h.hostname = c.hostname AND h.object = c.object AND h.day < c.day AND h.day >= c.day - 7 GROUP BY ALL
  HAVING count(*) >= 3""", "host"))
def a1_baseline_stats(spark, d):
    s = anomaly.point_stats(fx.host(spark, d).withColumn("day_no", F.unix_date("day")), ["hostname", "object"], "day_no")
    out = anomaly.rolling_baseline(s, ["hostname", "object"], "day_no", 7)
    return out.select(
        "hostname", "object", F.date_from_unix_date("day_no").alias("day"), "baseline_n", *r6("baseline_mean", "baseline_stddev")
    )


@query(
    fx.sql(
        "SELECT hostname, object, day, baseline_n::BIGINT AS baseline_n, fallback FROM b",
        "host",
        ctes=HOST_FINDINGS.replace("day >= c.day - 7", "day >= c.day - 1"),
    )
)
def a2_baseline_fallback(spark, d):
    s = anomaly.point_stats(fx.host(spark, d).withColumn("day_no", F.unix_date("day")), ["hostname", "object"], "day_no")
    out = anomaly.rolling_baseline(s, ["hostname", "object"], "day_no", 1, fallback_by=["hostname"])
    return out.select("hostname", "object", F.date_from_unix_date("day_no").alias("day"), "baseline_n", "fallback")


@query(
    fx.sql(
        "SELECT dbname, instance, event, begin_snap, round(coalesce(avg(pct), 0), 6) AS metric_value, max(snap_time) AS snap_time "
        "FROM wait GROUP BY ALL",
        "wait",
    )
)
def a3_current_value(spark, d):
    w = fx.wait(spark, d)
    return w.groupBy("dbname", "instance", "event", "begin_snap").agg(
        F.round(F.coalesce(F.avg("pct"), F.lit(0.0)), 6).alias("metric_value"), F.max("snap_time").alias("snap_time")
    )


@query(fx.sql("""SELECT w.hostname, w.object, w.wday AS day, count(*) AS n, round(avg(w.value), 6) AS metric_value
  FROM (SELECT *, day AS wday FROM host UNION ALL SELECT *, day - 1 FROM host WHERE snap_time <= (day + INTERVAL 1 HOUR)) w
  GROUP BY ALL""", "host"))
def w7_overlapping_windows(spark, d):
    w = anomaly.hour_windows(fx.host(spark, d))
    return w.groupBy("hostname", "object", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("metric_value"))


@query(
    fx.sql(
        "SELECT * FROM (SELECT dbname, instance, begin_snap, dense_rank() OVER (PARTITION BY dbname, instance "
        "ORDER BY begin_snap)::INT - 1 AS prior FROM (SELECT DISTINCT dbname, instance, begin_snap FROM wait)) WHERE prior >= 5",
        "wait",
    )
)
def w4_eligible_snapshots(spark, d):
    return anomaly.eligible_snapshots(fx.wait(spark, d), 5)


@query(
    fx.sql(
        "SELECT hostname, nullif(count(*) FILTER (WHERE severity = 'critical'), 0) AS critical, nullif(count(*) FILTER (WHERE severity "
        "= 'alert'), 0) AS alert, nullif(count(*) FILTER (WHERE severity = 'warning'), 0) AS warning, count(*) AS findings "
        "FROM findings GROUP BY hostname",
        "host",
        ctes=HOST_FINDINGS,
    )
)
def a13_severity_counts(spark, d):
    return rollups.severity_counts(_host_findings(spark, d), "hostname")


@query(
    fx.sql(
        "SELECT object, count(DISTINCT day) AS n_day, count(DISTINCT hostname) AS n_hostname, round(max(abs(z_score)), 6) AS max_abs_z "
        "FROM findings GROUP BY object",
        "host",
        ctes=HOST_FINDINGS,
    )
)
def a14_distinct_counts(spark, d):
    return rollups.distinct_counts(
        _host_findings(spark, d), ["object"], ["day", "hostname"]
    ).withColumn("max_abs_z", F.round("max_abs_z", 6))


@query(
    fx.sql(
        "SELECT hostname, object, count(*) AS times, round(max(abs(z_score)), 6) AS max_abs_z, round(avg(metric_value), 6) AS "
        "avg_value, round(avg(baseline_mean), 6) AS avg_baseline FROM findings GROUP BY ALL "
        "ORDER BY times DESC, max(abs(z_score)) DESC, hostname, object LIMIT 20",
        "host",
        ctes=HOST_FINDINGS,
    )
)
def a15_repeat_offenders(spark, d):
    return rollups.repeat_offenders(_host_findings(spark, d), ["hostname", "object"]).select(
        "hostname", "object", "times", *r6("max_abs_z", "avg_value", "avg_baseline")
    )


@query(
    fx.sql(
        "SELECT object_name, day, round(z_score, 6) AS z_score, severity FROM (SELECT *, object || '@' || day AS object_name "
        "FROM findings) WHERE hostname = 1 ORDER BY abs(z_score) DESC, object_name LIMIT 20",
        "host",
        ctes=HOST_FINDINGS,
    )
)
def p10_findings_list(spark, d):
    f = _host_findings(spark, d).withColumn("object_name", F.concat("object", F.lit("@"), F.col("day").cast("string")))
    return select.findings_list(f, 20, hostname=1).select("object_name", "day", *r6("z_score"), "severity")


@query(
    fx.sql(
        "SELECT hostname, object, day, severity, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 "
        "WHEN 'medium' THEN 3 ELSE 4 END AS sort_key FROM findings ORDER BY sort_key, abs(z_score) DESC, hostname, object, day LIMIT 50",
        "host",
        ctes=HOST_FINDINGS,
    )
)
def k3_severity_sort(spark, d):
    from ..functions.scalars import severity_order

    f = select.by_severity(_host_findings(spark, d), F.abs("z_score").desc(), F.col("hostname"), F.col("object"), F.col("day")).limit(50)
    return f.select("hostname", "object", "day", "severity", severity_order("severity").alias("sort_key"))
