"""Wait, statement and segment rollups: A4-A30, J1-J4, J7, W2, K1, K2, K4, U1-U3."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import scalars as S
from ..operators import rollups, select
from . import query
from .anomalies import r6

CLASSES = [("click", "User I/O"), (" Purchase ", "Commit"), ("ERROR", "Concurrency"), ("view", "User I/O")]
CLASS_SQL = (
    "dim AS (SELECT lower(trim(event)) AS e, wait_class FROM (VALUES ('click', 'User I/O'), (' Purchase ', 'Commit'), ('ERROR', "
    "'Concurrency'), ('view', 'User I/O')) v(event, wait_class))"
)
FG, BG = "event <> 'error'", "event = 'error'"
SQL_METRICS = {"elapsed": "elapsed", "cpu": "cpu", "parses": "parses"}
KEYS = "dbname, instance, begin_snap"


def _classes(spark):
    return spark.createDataFrame(CLASSES, "event string, wait_class string")


WAIT_SUMMARY = (
    f"SELECT {KEYS}, event, sum(waits)::BIGINT AS waits, round(sum(total_wait_time_s), 6) AS total_wait_time_s, round(avg(avg_wait_ms), "
    "6) AS avg_wait_ms, max(avg_wait_ms) AS max_wait_ms, min(avg_wait_ms) AS min_wait_ms, round(avg(pct), 6) AS avg_pct, round(0.5 * "
    "avg(pct) + 0.3 * sum(total_wait_time_s) + 0.2 * avg(avg_wait_ms), 9) AS score FROM wait "
    "WHERE pct > 5 AND total_wait_time_s > 0 AND %s GROUP BY ALL"
)


def _summary(w):
    out = rollups.wait_summary(w)
    return out.select(
        "dbname",
        "instance",
        "begin_snap",
        "event",
        "waits",
        *r6("total_wait_time_s", "avg_wait_ms"),
        "max_wait_ms",
        "min_wait_ms",
        *r6("avg_pct"),
        F.round("score", 9).alias("score"),
    )


@query(fx.sql(WAIT_SUMMARY % FG, "wait"))
def a4_fg_wait_summary(spark, d):
    return _summary(fx.wait(spark, d).where(FG))


@query(fx.sql(WAIT_SUMMARY % BG, "wait"))
def a5_bg_wait_summary(spark, d):
    return _summary(fx.wait(spark, d).where(BG))


EVENT_SUMMARY = (
    f"SELECT {KEYS}, event, coalesce(wait_class, 'Other') AS wait_class, sum(waits)::BIGINT AS waits, round(sum(total_wait_time_s), 6) "
    "AS total_wait_time_s, round(avg(avg_wait_ms), 6) AS avg_wait_ms, round(avg(pct), 6) AS avg_pct, CASE WHEN avg(pct) >= 20 THEN 5 "
    "WHEN avg(pct) >= 10 THEN 4 WHEN avg(pct) >= 5 THEN 3 WHEN avg(pct) >= 2 THEN 2 ELSE 1 END AS score FROM wait "
    "LEFT JOIN dim ON lower(trim(event)) = e WHERE %s GROUP BY ALL"
)


def _event_summary(spark, w):
    out = rollups.wait_event_summary(w, _classes(spark))
    return out.select(
        "dbname", "instance", "begin_snap", "event", "wait_class", "waits", *r6("total_wait_time_s", "avg_wait_ms", "avg_pct"), "score"
    )


@query(fx.sql(EVENT_SUMMARY % FG, "wait", ctes=CLASS_SQL))
def a6_fg_wait_event_summary(spark, d):
    return _event_summary(spark, fx.wait(spark, d).where(FG))


@query(fx.sql(EVENT_SUMMARY % BG, "wait", ctes=CLASS_SQL))
def a7_bg_wait_event_summary(spark, d):
    return _event_summary(spark, fx.wait(spark, d).where(BG))


@query(
    fx.sql(
        f"SELECT {KEYS}, CASE WHEN {FG} THEN 'foreground' ELSE 'background' END AS scope, event, coalesce(wait_class, 'Other') AS "
        "wait_class, sum(waits)::BIGINT AS waits, round(sum(total_wait_time_s), 6) AS total_wait_time_s, round(0.7 * avg(pct) + 0.2 * "
        "sum(total_wait_time_s) / 100 + 0.1 * avg(avg_wait_ms) / 10, 9) AS score FROM wait LEFT JOIN dim ON lower(trim(event)) = e "
        "GROUP BY ALL",
        "wait",
        ctes=CLASS_SQL,
    )
)
def a8_wait_summary(spark, d):
    w = fx.wait(spark, d)
    out = rollups.wait_summary_all(w.where(FG), w.where(BG), _classes(spark))
    return out.select(
        "dbname",
        "instance",
        "begin_snap",
        "scope",
        "event",
        "wait_class",
        "waits",
        *r6("total_wait_time_s"),
        F.round("score", 9).alias("score"),
    )


@query(
    fx.sql(
        "SELECT event, coalesce(wait_class, 'Other') AS wait_class, count(*) AS n FROM wait LEFT JOIN dim ON lower(trim(event)) = e "
        "GROUP BY ALL",
        "wait",
        ctes=CLASS_SQL,
    )
)
def j1_event_dimension(spark, d):
    return rollups.event_dimension(fx.wait(spark, d), _classes(spark)).groupBy("event", "wait_class").agg(F.count("*").alias("n"))


SQL_SUMMARY = (
    f"ss AS (SELECT {KEYS}, sql_id, avg(elapsed) AS elapsed, avg(cpu) AS cpu, avg(parses) AS parses, 0.25 * avg(elapsed) + 0.25 * "
    "avg(cpu) + 0.05 * avg(parses) / 1000 AS score FROM stmt GROUP BY ALL)"
)


@query(
    fx.sql(
        f"SELECT {KEYS}, sql_id, round(elapsed, 6) AS elapsed, round(cpu, 6) AS cpu, round(parses, 6) AS parses, round(score, 8) AS "
        "score FROM ss",
        "stmt",
        ctes=SQL_SUMMARY,
    )
)
def a9_sql_summary(spark, d):
    out = rollups.sql_summary(fx.stmt(spark, d), SQL_METRICS)
    return out.select("dbname", "instance", "begin_snap", "sql_id", *r6("elapsed", "cpu", "parses"), F.round("score", 8).alias("score"))


SEG_STAR = f"ss AS (SELECT {KEYS}, object_name, " + ", ".join(
    f"avg(value) FILTER (WHERE metric = '{m}') AS {m}" for m in fx.SEGMENT_METRICS
) + " FROM seg GROUP BY ALL HAVING count(*) FILTER (WHERE metric = 'logical_reads') > 0)"
_sum_sql = " + ".join(f"{2 if m in S.SEGMENT_DOUBLE else 1} * coalesce({m}, 0)" for m in fx.SEGMENT_METRICS)


@query(
    fx.sql(
        ""
        + f"SELECT {KEYS}, sql_id, round(avg(elapsed), 6) AS elapsed, round(avg(cpu), 6) AS cpu, "
        "round(avg(parses), 6) AS parses FROM stmt GROUP BY ALL",
        "stmt",
    )
)
def j2_star_of_aggregates(spark, d):
    s = fx.stmt(spark, d)
    keys = ["dbname", "instance", "begin_snap", "sql_id"]
    out = rollups.star_by_joins({m: s.select(*keys, F.col(c).cast("double").alias("value")) for m, c in SQL_METRICS.items()}, keys)
    return out.select(*keys, *r6("elapsed", "cpu", "parses"))


@query(
    fx.sql(f"SELECT {KEYS}, object_name, {', '.join(f'round({m}, 6) AS {m}' for m in fx.SEGMENT_METRICS)} FROM ss", "seg", ctes=SEG_STAR)
)
def j3_star_of_aggregates_entity(spark, d):
    keys = ["dbname", "instance", "begin_snap", "object_name"]
    out = rollups.star_of_aggregates(fx.seg(spark, d), keys, list(fx.SEGMENT_METRICS), driving="logical_reads")
    return out.select(*keys, *r6(*fx.SEGMENT_METRICS))


@query(fx.sql(f"SELECT {KEYS}, object_name, round({_sum_sql}, 8) AS score FROM ss", "seg", ctes=SEG_STAR))
def a10_segment_summary_entity(spark, d):
    out = rollups.segment_summary(fx.seg(spark, d), list(fx.SEGMENT_METRICS), "logical_reads")
    return out.select("dbname", "instance", "begin_snap", "object_name", F.round("score", 8).alias("score"))


_others = [m for m in fx.SEGMENT_METRICS if m != "logical_reads"]
COARSE = f"o AS (SELECT {KEYS}, object_name, avg(value) AS logical_reads FROM seg WHERE metric = 'logical_reads' GROUP BY ALL), s AS (SELECT {KEYS}, " + ", ".join(
    f"sum(value::DECIMAL(28,6)) FILTER (WHERE metric = '{m}')::DOUBLE / nullif(count(value) FILTER (WHERE metric = '{m}'), 0) AS {m}"
    for m in _others
) + " FROM seg WHERE metric <> 'logical_reads' GROUP BY ALL)"
_weighted_sql = " + ".join(f"{S.SEGMENT_WEIGHTS[m]} * coalesce({m}, 0)" for m in fx.SEGMENT_METRICS if m in S.SEGMENT_WEIGHTS)


@query(
    fx.sql(
        f"SELECT {KEYS}, object_name, {', '.join(f'round({m}, 6) AS {m}' for m in fx.SEGMENT_METRICS)} FROM o LEFT JOIN s USING ({KEYS})",
        "seg",
        ctes=COARSE,
    )
)
def j4_star_of_aggregates_coarse(spark, d):
    out = rollups.segment_summary_coarse(fx.seg(spark, d), list(fx.SEGMENT_METRICS), "logical_reads")
    return out.select("dbname", "instance", "begin_snap", "object_name", *r6(*fx.SEGMENT_METRICS))


@query(fx.sql(f"SELECT {KEYS}, object_name, round({_weighted_sql}, 8) AS score FROM o LEFT JOIN s USING ({KEYS})", "seg", ctes=COARSE))
def a10_segment_summary_coarse(spark, d):
    out = rollups.segment_summary_coarse(fx.seg(spark, d), list(fx.SEGMENT_METRICS), "logical_reads")
    return out.select("dbname", "instance", "begin_snap", "object_name", F.round("score", 8).alias("score"))


@query(
    fx.sql(
        "SELECT begin_snap, lower(dbname) AS dbname, sql_id::VARCHAR AS entity, round(avg(score), 8) AS score FROM ss GROUP BY ALL",
        "stmt",
        ctes=SQL_SUMMARY,
    )
)
def a11_score_by_snap(spark, d):
    return rollups.score_by_snap(rollups.sql_summary(fx.stmt(spark, d), SQL_METRICS), "sql_id").withColumn("score", F.round("score", 8))


@query(
    fx.sql(
        f"SELECT dbname, instance, event, round(100 * sum(p) / nullif(sum(t), 0), 6) AS share FROM (SELECT {KEYS}, event, sum(pct) AS p "
        f"FROM wait GROUP BY ALL) JOIN (SELECT {KEYS}, sum(pct) AS t FROM wait GROUP BY ALL) USING ({KEYS}) GROUP BY ALL",
        "wait",
    )
)
def a12_share_of_total(spark, d):
    return rollups.share_of_total(fx.wait(spark, d)).withColumn("share", F.round("share", 6))


@query(
    fx.sql(
        "SELECT event, round(avg(pct), 6) AS avg_pct, round(avg(avg_wait_ms), 6) AS avg_ms, sum(waits)::BIGINT AS waits, "
        "round(sum(total_wait_time_s), 4) AS time_s FROM wait GROUP BY event ORDER BY avg(pct) DESC NULLS LAST, event LIMIT 3",
        "wait",
    )
)
def a16_top_waits(spark, d):
    return rollups.top_waits(fx.wait(spark, d), 3).select("event", *r6("avg_pct", "avg_ms"), "waits", F.round("time_s", 4).alias("time_s"))


@query(
    fx.sql(
        "SELECT sql_id, round(sum(elapsed), 2) AS elapsed, round(avg(elapsed), 4) AS avg_elapsed, sum(executions) AS executions, "
        "round(sum(cpu), 3) AS cpu FROM stmt GROUP BY sql_id ORDER BY sum(elapsed) DESC, sql_id LIMIT 20",
        "stmt",
    )
)
def a17_top_sql(spark, d):
    return rollups.top_sql(fx.stmt(spark, d)).select(
        "sql_id",
        F.round("elapsed", 2).alias("elapsed"),
        F.round("avg_elapsed", 4).alias("avg_elapsed"),
        "executions",
        F.round("cpu", 3).alias("cpu"),
    )


@query(
    fx.sql(
        "SELECT * FROM (SELECT metric, owner, object_name, obj_type, round(total, 4) AS total, round(avg_value, 6) AS avg_value, "
        "row_number() OVER (PARTITION BY metric ORDER BY total DESC, owner, object_name)::INT AS rank_in_group "
        "FROM (SELECT metric, owner, object_name, obj_type, sum(value) AS total, avg(value) AS avg_value FROM seg GROUP BY ALL)) "
        "WHERE rank_in_group <= 5",
        "seg",
    )
)
def a18_top_segments(spark, d):
    seg = fx.seg(spark, d)
    return rollups.top_segments(seg, list(fx.SEGMENT_METRICS)).select(
        "metric", "owner", "object_name", "obj_type", F.round("total", 4).alias("total"), *r6("avg_value"), "rank_in_group"
    )


@query(fx.sql("SELECT metric, round(avg(per_sec), 4) AS avg_value FROM load WHERE metric ILIKE '%h%' GROUP BY metric", "load"))
def a19_efficiency_avg(spark, d):
    return rollups.average_by(fx.load(spark, d), "metric", "per_sec", "%h%").withColumn("avg_value", F.round("avg_value", 4))


@query(
    fx.sql(
        "SELECT dbname, "
        + ", ".join(f"round(quantile_cont(m, {p}), 3) AS p{round(p * 100)}" for p in (0.1, 0.4, 0.7, 0.9))
        + " FROM (SELECT dbname, sql_id, avg(score) AS m FROM ss GROUP BY ALL) GROUP BY dbname",
        "stmt",
        ctes=SQL_SUMMARY,
    )
)
def a20_percentile_thresholds(spark, d):
    out = rollups.percentile_thresholds(rollups.sql_summary(fx.stmt(spark, d), SQL_METRICS), "sql_id", ["dbname"])
    return out.select("dbname", *[F.round(c, 3).alias(c) for c in ("p10", "p40", "p70", "p90")])


@query(
    fx.sql(
        "SELECT hostname, object, round(avg(util), 6) AS avg_util, max(util) AS peak_util, round(avg(await_ms), 6) AS avg_await_ms, "
        "max(await_ms) AS peak_await_ms, CASE WHEN avg(util) >= 85 THEN 'critical' WHEN avg(util) >= 60 THEN 'warning' "
        "WHEN avg(await_ms) >= 50 THEN 'slow' ELSE 'ok' END AS status FROM (SELECT *, value * 4 AS util, value AS await_ms FROM host) "
        "GROUP BY ALL",
        "host",
    )
)
def a21_device_scorecard(spark, d):
    h = fx.host(spark, d).withColumns({"util": F.col("value") * 4, "await_ms": F.col("value"), "tps": F.col("value")})
    return rollups.device_scorecard(h).select(
        "hostname", "object", *r6("avg_util"), "peak_util", *r6("avg_await_ms"), "peak_await_ms", "status"
    )


@query(fx.sql("SELECT object AS metric, round(avg(value), 6) AS avg_value FROM host WHERE hostname = 2 GROUP BY object", "host"))
def a22_host_gauges(spark, d):
    return rollups.average_by(fx.host(spark, d).where("hostname = 2"), "object", "value").withColumn("avg_value", F.round("avg_value", 6))


@query(
    fx.sql(
        "SELECT hostname, date_trunc('hour', snap_time) AS hour, round(sum(value), 4) AS total, max(value) AS peak FROM host GROUP BY ALL",
        "host",
    )
)
def a23_per_timestamp_rollup(spark, d):
    h = fx.host(spark, d).withColumn("hour", F.date_trunc("hour", "snap_time").cast("timestamp_ntz"))
    return rollups.per_timestamp(h, ["hostname", "hour"], total=F.round(F.sum("value"), 4), peak=F.max("value"))


@query(fx.sql("SELECT owner, string_agg(DISTINCT obj_type, ', ' ORDER BY obj_type) AS bullets FROM seg GROUP BY owner", "seg"))
def a24_ordered_string_agg(spark, d):
    return rollups.ordered_bullets(fx.seg(spark, d), ["owner"], "obj_type", distinct=True, sep=", ")


@query(
    fx.sql(
        "SELECT hostname, day, max(CASE WHEN object ILIKE 'cl%' THEN value END) AS free_mb, max(CASE "
        "WHEN object ILIKE '%ERR%' THEN value END) AS total_mb FROM host GROUP BY ALL",
        "host",
    )
)
def a25_conditional_pivot(spark, d):
    return rollups.conditional_pivot(fx.host(spark, d), ["hostname", "day"], "object", "value", {"free_mb": "cl%", "total_mb": "%ERR%"})


@query(
    fx.sql(
        "SELECT owner, object_type, objects::DOUBLE AS objects, last_days::DOUBLE AS last_days, CASE "
        "WHEN objects IS NULL THEN 'missing' WHEN last_days > 5 THEN 'overdue' ELSE 'ok' END AS status FROM (SELECT DISTINCT owner "
        "FROM meta UNION SELECT 'Brand#none') LEFT JOIN (SELECT owner, object_type, count(*) AS objects, min(analysed_days) AS "
        "last_days FROM meta GROUP BY ALL) USING (owner)",
        "meta",
    )
)
def a26_metadata_inventory(spark, d):
    m = fx.meta(spark, d)
    owners = m.select("owner").distinct().union(spark.range(1).select(F.lit("Brand#none")))
    out = rollups.metadata_inventory(m, owners, 5)
    return out.withColumns({c: F.col(c).cast("double") for c in ("objects", "last_days")})


@query(
    fx.sql(
        "SELECT dbname, instance, min(snap_time) AS min_snap_time, max(snap_time) AS max_snap_time, min(begin_snap) AS min_begin_snap, "
        "max(begin_snap) AS max_begin_snap FROM load GROUP BY ALL",
        "load",
    )
)
def a27_series_bounds(spark, d):
    return rollups.series_bounds(fx.load(spark, d), ["dbname", "instance"], ["snap_time", "begin_snap"])


@query(
    fx.sql(
        "SELECT count(DISTINCT dbname) AS n_dbname, count(DISTINCT instance) AS n_instance, count(DISTINCT begin_snap) AS n_begin_snap "
        "FROM load",
        "load",
    )
)
def a28_usage_counts(spark, d):
    return rollups.usage_counts(fx.load(spark, d), ["dbname", "instance", "begin_snap"])


@query(
    fx.sql(
        "SELECT coalesce(wait_class, 'Other') AS wait_class, sum(waits)::BIGINT AS waits, round(sum(total_wait_time_s), 4) AS time_s, "
        "round(avg(avg_wait_ms), 6) AS avg_ms FROM wait LEFT JOIN dim ON lower(trim(event)) = e GROUP BY ALL ORDER BY time_s DESC "
        "LIMIT 10",
        "wait",
        ctes=CLASS_SQL,
    )
)
def a29_class_rollup(spark, d):
    return rollups.class_rollup(fx.wait(spark, d), _classes(spark)).select(
        "wait_class", "waits", F.round("time_s", 4).alias("time_s"), *r6("avg_ms")
    )


@query(
    fx.sql(
        "SELECT owner, object_name, count(DISTINCT begin_snap) AS snaps, round(CASE "
        "WHEN count(DISTINCT begin_snap) = 1 THEN max(value) ELSE avg(value) END, 6) AS rank_value FROM seg "
        "WHERE metric = 'logical_reads' AND value >= 10 GROUP BY ALL ORDER BY CASE "
        "WHEN count(DISTINCT begin_snap) = 1 THEN max(value) ELSE avg(value) END DESC, owner, object_name LIMIT 20",
        "seg",
    )
)
def a30_segment_panel(spark, d):
    return rollups.segment_panel(fx.seg(spark, d), "logical_reads", 10, 20).select("owner", "object_name", "snaps", *r6("rank_value"))


@query(
    fx.sql(
        "SELECT hostname, object, snap_time, value FROM host WHERE object IN (SELECT object FROM host GROUP BY object "
        "ORDER BY avg(value) DESC, object LIMIT 2)",
        "host",
    )
)
def j7_topn_semi(spark, d):
    return select.topn_semi(fx.host(spark, d), "object", "value", 2).select("hostname", "object", "snap_time", "value")


@query(
    fx.sql(
        "SELECT hostname, object, snap_time, value FROM (SELECT *, row_number() OVER (PARTITION BY hostname, object "
        "ORDER BY snap_time DESC, value DESC) AS n FROM host) WHERE n = 1",
        "host",
    )
)
def w2_distinct_on(spark, d):
    return select.newest_by(
        fx.host(spark, d), ["hostname", "object"], F.desc("snap_time"), F.desc("value")
    ).select("hostname", "object", "snap_time", "value")


@query(
    fx.sql(
        "SELECT sql_id, round(elapsed, 6) AS elapsed FROM (SELECT sql_id, max(elapsed) AS elapsed FROM stmt GROUP BY sql_id) "
        "ORDER BY elapsed DESC NULLS LAST, sql_id LIMIT 10",
        "stmt",
    )
)
def k1_top_k(spark, d):
    out = fx.stmt(spark, d).groupBy("sql_id").agg(F.max("elapsed").alias("elapsed"))
    return select.top_k(out, 10, F.col("elapsed").desc_nulls_last(), F.col("sql_id")).select("sql_id", *r6("elapsed"))


@query(
    fx.sql(
        "SELECT * FROM (SELECT dbname, sql_id, round(e, 2) AS e, row_number() OVER (PARTITION BY dbname "
        "ORDER BY e DESC, sql_id)::INT AS rank_in_group FROM (SELECT dbname, sql_id, sum(elapsed) AS e FROM stmt GROUP BY ALL)) "
        "WHERE rank_in_group <= 5",
        "stmt",
    )
)
def k2_top_k_per_group(spark, d):
    s = fx.stmt(spark, d).groupBy("dbname", "sql_id").agg(F.sum("elapsed").alias("e"))
    return select.top_k_per_group(s, ["dbname"], 5, F.desc("e"), F.col("sql_id")).withColumn("e", F.round("e", 2))


@query(
    fx.sql(
        "SELECT owner, object_name, metric, value FROM (SELECT *, row_number() OVER (PARTITION BY owner "
        "ORDER BY value DESC, object_name, metric, dbname, instance, begin_snap) AS n FROM seg) WHERE n = 1",
        "seg",
    )
)
def k4_first_per_key(spark, d):
    return select.newest_by(
        fx.seg(spark, d), ["owner"], F.desc("value"), *map(F.col, ["object_name", "metric", "dbname", "instance", "begin_snap"])
    ).select("owner", "object_name", "metric", "value")


@query(
    fx.sql(
        "SELECT priority, event, n FROM (SELECT 1 AS priority, event, count(*) AS n FROM wait WHERE event <> 'error' GROUP BY event "
        "UNION ALL SELECT 2, event, count(*) FROM wait WHERE event = 'error' GROUP BY event)",
        "wait",
    )
)
def u1_union_all(spark, d):
    w = fx.wait(spark, d)
    part = lambda cond, p: w.where(cond).groupBy("event").agg(F.count("*").alias("n")).select(F.lit(p).alias("priority"), "event", "n")
    return part(FG, 1).unionByName(part(BG, 2))


@query(fx.sql("SELECT sql_id FROM stmt WHERE elapsed > 90000 UNION SELECT sql_id FROM stmt WHERE parses >= 7", "stmt"))
def u2_union_distinct(spark, d):
    s = fx.stmt(spark, d)
    return select.union_distinct(s.where("elapsed > 90000").select("sql_id"), s.where("parses >= 7").select("sql_id"))


@query(fx.sql("SELECT DISTINCT owner, obj_type FROM seg", "seg"))
def u3_distinct(spark, d):
    return select.distinct_rows(fx.seg(spark, d), ["owner", "obj_type"])
