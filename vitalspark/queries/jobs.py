"""Rules X4, X5, host panels X11, feedback X16, X17, X18, sinks SNK1-SNK4 and streams S1-S4."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixture_texts as ft
from .. import fixtures as fx
from ..operators import rollups
from ..plans import hosts, rules
from ..sinks import KeyedTable
from ..sources import report
from ..storage import shared_dir
from ..streaming import jobs as streams
from . import query
from .anomalies import BACK, FINDING, HOST_FINDINGS, SNAP_FINDINGS, Z, r6
from .waits import SQL_METRICS, SQL_SUMMARY

RULES = [
    rules.Rule("w1", "wait", "cl*", "pct_db_time > 12 and avg_wait_ms > 50", "high", "click waits"),
    rules.Rule("w2", "wait", "error", "pct_db_time >= 11", "critical", "errors"),
    rules.Rule("w3", "wait", "*", "total_waits > 14", "medium", "many waits"),
    rules.Rule("w4", "wait", "*", "pct_db_time > 0", "low", "any wait"),
    rules.Rule("s1", "sql", "*", "elapsed_time_s > 90000 or (executions between 1 and 2 and cpu_time_s > 80000)", "high", "long statement"),
    rules.Rule("s2", "sql", "7", "parse_calls > 6", "medium", "parsing"),
]


@query(fx.sql("""SELECT dbname, rule_id, min(entity) AS entity, count(*) AS hits FROM (SELECT dbname::VARCHAR AS dbname, event AS entity,
  CASE WHEN event LIKE 'cl%' AND pct > 12 AND ms > 50 THEN 'w1' WHEN event = 'error' AND pct >= 11 THEN 'w2'
  WHEN n > 14 THEN 'w3' ELSE 'w4' END AS rule_id FROM (SELECT dbname, instance, begin_snap, event, avg(pct) AS pct, avg(avg_wait_ms) AS
  ms, sum(waits) AS n FROM wait GROUP BY ALL)
UNION ALL SELECT dbname, sql_id::VARCHAR, CASE WHEN e > 90000 OR (x BETWEEN 1 AND 2 AND c > 80000) THEN 's1'
  WHEN sql_id = 7 AND p > 6 THEN 's2' END FROM (SELECT dbname, instance, begin_snap, sql_id, avg(elapsed) AS e, avg(cpu) AS c,
  avg(parses) AS p, avg(executions) AS x FROM stmt GROUP BY ALL)) WHERE rule_id IS NOT NULL AND rule_id <> 'w4'
  GROUP BY dbname, rule_id""", "wait", "stmt"))
def x4_recommendations(spark, d):
    key = ["dbname", "instance", "begin_snap"]
    w = fx.wait(spark, d).groupBy(*key, "event").agg(
        F.avg("pct").alias("pct_db_time"), F.avg("avg_wait_ms").alias("avg_wait_ms"), F.sum("waits").alias("total_waits")
    )
    s = fx.stmt(spark, d).groupBy(*key, "sql_id").agg(
        F.avg("elapsed").alias("elapsed_time_s"),
        F.avg("cpu").alias("cpu_time_s"),
        F.avg("parses").alias("parse_calls"),
        F.avg("executions").alias("executions"),
        F.lit(None).cast("double").alias("parse_calls_pct"),
    )
    as_text = lambda df: df.withColumn("dbname", F.col("dbname").cast("string"))
    return rules.recommendations(
        {"wait": (as_text(w), "event"), "sql": (as_text(s), "sql_id")}, RULES, ["dbname"]
    ).select("dbname", "rule_id", "entity", "hits")


_R = rules.Rule
FULL_RULES = [
    _R("fw1", "wait", "cl*", "pct_db_time > 9.9", "high", "click waits", "hot pages", ("look", "act"), ("select 1",), ("fw2",)),
    _R("fw2", "wait", "*", "total_waits > 10", "medium", "many waits", "load", ("scale",)),
    _R("fs1", "sql", "high_elapsed_time", "elapsed_time_s / executions > 1000 and cpu_time_s = 0", "critical", "slow", "plan", ("tune",), (), ("fs2", "fs3")),
    _R("fs2", "sql", "high_parse_calls", "parse_calls_pct > 15", "medium", "parsing", "", (), ("select 2", "select 3")),
    _R("fs3", "sql", "high_parse_calls", "parse_calls > 0", "critical", "never: not the first of its pattern"),
    _R("fe1", "instance_efficiency", "buffer_cache_hit_ratio", "value < 90", "high", "cache", "small cache", ("grow",)),
    _R("fe2", "instance_efficiency", "Own metric", "value > 1", "low", "below the least severity"),
    _R("fg1", "segment", "high_logical_reads", "logical_reads > 10 and pcttotal > 0", "medium", "hot segment", "scans", ("index",)),
    _R("fg2", "segment", "high_physical_reads", "physical_reads > 10", "high", "cold segment"),
]
#: Findings before their texts: the reference's cuts (five statements, three segments) by window, rules by hand.
FULL_SQL = """w AS (SELECT dbname, event, avg(pct) AS p, sum(waits) AS n FROM wait GROUP BY ALL),
t AS (SELECT dbname, sql_id, sum(elapsed) AS e, sum(parses) AS c, sum(executions) AS x FROM stmt GROUP BY ALL),
te AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dbname ORDER BY e DESC, sql_id) <= 5),
tp AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY dbname ORDER BY c DESC, sql_id) <= 5),
g AS (SELECT dbname, owner, object_name, metric, sum(value) AS v FROM seg WHERE metric IN ('logical_reads', 'physical_reads') GROUP BY dbname, owner, object_name, metric
  QUALIFY row_number() OVER (PARTITION BY dbname, metric ORDER BY coalesce(sum(value), 0) DESC, owner, object_name) <= 3),
f AS (SELECT dbname::VARCHAR AS dbname, event AS entity, p AS value, CASE WHEN event LIKE 'cl%' AND p > 9.9 THEN 'fw1' WHEN n > 10 THEN 'fw2' END AS rule_id FROM w
  UNION ALL SELECT dbname::VARCHAR, sql_id::VARCHAR, e, CASE WHEN e / x > 1000 THEN 'fs1' END FROM te
  UNION ALL SELECT dbname::VARCHAR, sql_id::VARCHAR, c, CASE WHEN c / greatest(x, 1) * 100 > 15 THEN 'fs2' END FROM tp
  UNION ALL SELECT dbname::VARCHAR, 'buffer_cache_hit_ratio', p, CASE WHEN p < 90 THEN 'fe1' END FROM w WHERE event = 'view'
  UNION ALL SELECT dbname::VARCHAR, owner || '.' || object_name, v, CASE WHEN metric = 'logical_reads' AND v > 10 THEN 'fg1'
    WHEN metric = 'physical_reads' AND v > 10 THEN 'fg2' END FROM g),
b AS (SELECT dbname, rule_id, count(*) AS hits, arg_min(entity, {'d': -round(value, 6), 'e': entity}) AS entity, max(value) AS value
  FROM f WHERE rule_id IS NOT NULL GROUP BY ALL)"""
_TEXTS = ", ".join(
    "(" + ", ".join("'" + x + "'" for x in (r.rule_id, r.category, r.severity, r.title, r.root_cause, "|".join(r.resolution), "|".join(r.diagnostic_sql), "|".join(r.related))) + ")"
    for r in FULL_RULES
)


@query(
    fx.sql(
        f"SELECT dbname, rule_id, category, entity, round(value, 4) AS value, severity, title, root_cause, resolution, diagnostic_sql, related_rules, hits "
        f"FROM b JOIN (VALUES {_TEXTS}) r(rule_id, category, severity, title, root_cause, resolution, diagnostic_sql, related_rules) USING (rule_id)",
        "wait", "stmt", "seg", ctes=FULL_SQL
    )
)
def x4_all_findings(spark, d):
    """Recommendations whole: leading statements and segments, ratios by their names, causes, steps, diagnostic SQL and related rules."""
    key = ["dbname"]
    as_text = lambda df: df.withColumn("dbname", F.col("dbname").cast("string"))
    w = fx.wait(spark, d)
    waits = w.groupBy(*key, "event").agg(F.avg("pct").alias("pct_db_time"), F.avg("avg_wait_ms").alias("avg_wait_ms"), F.sum("waits").alias("total_waits"))
    s = fx.stmt(spark, d).groupBy(*key, "sql_id").agg(
        F.sum("elapsed").alias("elapsed_time_s"), F.sum("cpu").alias("cpu_time_s"), F.sum("parses").alias("parse_calls"), F.sum("executions").alias("executions")
    )
    # the first name of the ratio is missing, so its second name counts
    e = w.where("event in ('view', 'click')").select(*key, F.when(F.col("event") == "view", "Buffer Nowait %").otherwise("Own metric").alias("metric"), F.col("pct").alias("value"))
    g = fx.seg(spark, d).groupBy(*key, "owner", "object_name", "metric").agg(F.sum("value").alias("value")).withColumn("pct", F.lit(1.0))
    found = rules.all_findings(as_text(waits), as_text(s), as_text(e), as_text(g), FULL_RULES, key)
    lists = {c: F.array_join(c, "|") for c in ("resolution", "diagnostic_sql", "related_rules")}
    return found.withColumns({**lists, "value": F.round("value", 4)}).select(
        "dbname", "rule_id", "category", "entity", "value", "severity", "title", "root_cause", "resolution", "diagnostic_sql", "related_rules", "hits"
    )


@query(fx.sql("""SELECT owner, object_name, u.r[1] AS rule, u.r[2] AS severity FROM (SELECT owner, object_name, unnest([CASE
  WHEN analysed_days IS NULL THEN ['missing statistics', 'high'] END, CASE WHEN analysed_days > 90 THEN ['stale statistics', 'high']
  WHEN analysed_days > 30 THEN ['stale statistics', 'medium'] END,
 CASE WHEN t <> 'TABLE' AND ratio > 1.5 THEN ['clustering', 'high'] WHEN t <> 'TABLE' AND ratio > 0.8 THEN ['clustering', 'medium'] END,
  CASE WHEN t <> 'TABLE' AND blevel >= 5 THEN ['index depth', 'high']
  WHEN t <> 'TABLE' AND blevel >= 4 THEN ['index depth', 'medium'] END,
 CASE WHEN t = 'TABLE' AND partition_type IS NULL AND num_rows > 1e8 THEN ['not partitioned', 'high']
  WHEN t = 'TABLE' AND partition_type IS NULL AND num_rows > 1e7 THEN ['not partitioned', 'medium'] END, CASE
  WHEN t = 'TABLE' AND compression IS NULL AND num_rows > 5e7 THEN ['not compressed', 'medium'] END]) AS r
 FROM (SELECT *, object_type AS t, clustering_factor / nullif(num_rows, 0) AS ratio FROM meta)) u WHERE r IS NOT NULL""", "meta"))
def x5_metadata_rules(spark, d):
    return rules.metadata_rules(fx.meta(spark, d))


@query(
    fx.sql(
        "SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY avg_value DESC, object) <= 2 AS busy "
        "FROM (SELECT hostname, object, count(*) AS samples, round(avg(value), 6) AS avg_value, max(value) AS peak, "
        "round(quantile_cont(value, 0.95), 6) AS p95, count(DISTINCT date_trunc('hour', snap_time)) AS hours FROM host "
        "WHERE day BETWEEN '2024-01-03' AND '2024-01-20' GROUP BY ALL)",
        "host",
    )
)
def x11_host_overview(spark, d):
    return hosts.host_overview(fx.host(spark, d), "2024-01-03", "2024-01-20").select(
        "hostname", "object", "samples", *r6("avg_value"), "peak", *r6("p95"), "hours", "busy"
    )


TIMELINE = """WITH host AS ({host}), g AS (SELECT hostname, object, date_trunc('hour', snap_time) AS at_, count(*) AS samples, avg(value)
  AS mean, max(value) AS peak
  FROM host WHERE day BETWEEN '2024-01-03' AND '2024-01-20' GROUP BY ALL),
b AS (SELECT hostname, object FROM (SELECT hostname, object, row_number() OVER (PARTITION BY hostname
  ORDER BY avg(value) DESC, object) AS n
  FROM host WHERE day BETWEEN '2024-01-03' AND '2024-01-20' GROUP BY hostname, object) WHERE n <= 2)
SELECT hostname, object, at_ AS at, samples, round(mean, 6) AS mean, peak, round(mean - lag(mean) OVER (PARTITION BY hostname, object
  ORDER BY at_), 6) AS change,
  round(mean / nullif(max(mean) OVER (PARTITION BY hostname, object), 0) * 100, 6) AS share_pct
FROM g JOIN b USING (hostname, object)""".format(host=fx.SQL["host"])


@query(TIMELINE)
def x11_host_timeline(spark, d):
    out = hosts.host_timeline(fx.host(spark, d), "2024-01-03", "2024-01-20")
    return out.select("hostname", "object", "at", "samples", *r6("mean"), "peak", *r6("change", "share_pct"))


FEEDBACK = (
    "fb AS (SELECT event_type || ':' || (user_id % 20) AS trigger_pattern, value > 50 AS accepted, 'r' || event_id AS resolution, ts AS "
    "at FROM events)"
)


def _feedback(spark, d):
    e = fx.table(spark, d, "events")
    return e.select(
        F.concat("event_type", F.lit(":"), (F.col("user_id") % 20).cast("string")).alias("trigger_pattern"),
        (F.col("value") > 50).alias("accepted"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("resolution"),
        F.col("ts").alias("at"),
    )


@query(
    "WITH "
    + FEEDBACK.replace(" at ", " t ").replace("AS at", "AS t")
    + " SELECT trigger_pattern, count(*) AS times_accepted, arg_max(resolution, t) AS resolution FROM fb "
    "WHERE accepted GROUP BY trigger_pattern"
)
def x16_feedback_learnings(spark, d):
    f = _feedback(spark, d)
    half = F.col("at") < F.lit("2024-01-15").cast("timestamp_ntz")
    known = hosts.feedback_learnings(f.where(half))
    return hosts.feedback_learnings(f.where(~half), known).select("trigger_pattern", "times_accepted", "resolution")


@query(
    "WITH "
    + FEEDBACK.replace("AS at", "AS t")
    + " SELECT trigger_pattern, times_accepted FROM (SELECT trigger_pattern, count(*) AS times_accepted "
    "FROM fb WHERE accepted GROUP BY trigger_pattern) WHERE trigger_pattern LIKE 'click:%' "
    "ORDER BY trigger_pattern = 'click:3' DESC, times_accepted DESC, trigger_pattern LIMIT 3"
)
def x16_best_learnings(spark, d):
    return hosts.best_learnings(hosts.feedback_learnings(_feedback(spark, d)), "click:3").select("trigger_pattern", "times_accepted")


@query(
    fx.sql(
        "SELECT t.sql_id, parse_calls, executions, begin_snap::DOUBLE AS begin_snap, md5(sql_text) AS text_md5 "
        "FROM (SELECT sql_id, sum(parses)::BIGINT AS parse_calls, sum(executions) AS executions FROM stmt GROUP BY sql_id "
        "HAVING sum(parses) > 100 ORDER BY executions DESC, sql_id LIMIT 10) t "
        "LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY sql_id ORDER BY begin_snap DESC) AS n "
        "FROM txt) x ON x.sql_id = t.sql_id AND n = 1",
        "stmt",
        "txt",
    )
)
def x17_parse_hotspots(spark, d):
    out = hosts.parse_hotspots(fx.stmt(spark, d), fx.text(spark, d), 100)
    return out.select(
        "sql_id", "parse_calls", "executions", F.col("begin_snap").cast("double").alias("begin_snap"), F.md5("sql_text").alias("text_md5")
    )


@query(
    fx.sql(
        "SELECT sql_id, round(max(score), 6) AS score, round(arg_max(elapsed, score), 6) AS elapsed, round(arg_max(cpu, score), 6) AS "
        "cpu FROM ss GROUP BY sql_id ORDER BY max(score) DESC, sql_id LIMIT 10",
        "stmt",
        ctes=SQL_SUMMARY,
    )
)
def x18_sql_scorecard(spark, d):
    return hosts.sql_scorecard(
        rollups.sql_summary(fx.stmt(spark, d), SQL_METRICS), list(SQL_METRICS)
    ).select("sql_id", *r6("score", "elapsed", "cpu"))


# --- sinks -----------------------------------------------------------------------------------------------------------


def _table(spark, name, partitions):
    return KeyedTable(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", partitions)


def _orders(spark, d):
    return fx.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("dbname"),
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("note"),
    )


@query("SELECT o_orderstatus AS dbname, o_orderkey AS id, o_totalprice AS price FROM orders")
def snk1_insert_if_absent(spark, d):
    t = _table(spark, "snk1", ["dbname"])
    o = _orders(spark, d)
    t.insert_if_absent(o.where("note <> '5-LOW'").drop("note"), ["dbname", "id"])
    o = o.drop("note")
    t.insert_if_absent(o, ["dbname", "id"])
    t.insert_if_absent(o.union(o), ["dbname", "id"])
    return t.read().select("dbname", "id", "price")


@query(
    "SELECT o_orderstatus AS dbname, o_orderkey AS id, CASE "
    "WHEN o_totalprice >= 200000 AND o_orderstatus <> 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS note "
    "FROM orders"
)
def snk2_upsert(spark, d):
    o = _orders(spark, d)
    t = _table(spark, "snk2", ["dbname"])
    t.upsert(o.where("price < 400000 or dbname = 'P'"), ["dbname", "id"])
    new = o.where("price >= 200000 and dbname <> 'P'").withColumns(
        {"note": F.when(F.col("price") >= 400000, F.col("note")).otherwise("not taken"), "price": F.col("price") + 1}
    )
    for _ in range(2):
        t.upsert(new, ["dbname", "id"], refresh=["price"])
    return t.read().select("dbname", "id", "price", "note")


@query(fx.sql("SELECT dbname, begin_snap, count(*) AS n, round(sum(elapsed), 2) AS elapsed FROM stmt GROUP BY ALL", "stmt"))
def snk3_view_refresh(spark, d):
    s = fx.stmt(spark, d)
    t = _table(spark, "snk3", ["dbname", "begin_snap"])
    roll = lambda df: df.groupBy("dbname", "begin_snap").agg(F.count("*").alias("n"), F.round(F.sum("elapsed"), 2).alias("elapsed"))
    early = s.where("begin_snap < 40 or executions > 10")
    t.refresh(early, lambda keys: roll(early.join(keys, ["dbname", "begin_snap"], "left_semi")))
    t.refresh(s.where("begin_snap >= 40"), lambda keys: roll(s.join(keys, ["dbname", "begin_snap"], "left_semi")))
    return t.read().select("dbname", "begin_snap", "n", "elapsed")


@query(
    "SELECT o_orderstatus AS dbname, o_orderkey AS id FROM orders "
    "WHERE NOT (o_totalprice > 300000 AND o_orderstatus <> 'F') AND o_orderstatus <> 'P'"
)
def snk4_delete(spark, d):
    o = _orders(spark, d)
    t = _table(spark, "snk4", ["dbname"])
    t.insert_if_absent(o, ["dbname", "id"])
    t.delete(o.where("(price > 300000 and dbname <> 'F') or dbname = 'P'"), ["dbname", "id"])
    return t.read().select("dbname", "id")


# --- streams ---------------------------------------------------------------------------------------------------------


def _report_files(spark, d):
    """Reports as text files of the shared folder, one file for each report, each content twice; dealt over all tasks by name."""
    path = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex[:12]}"
    f = ft.reports(spark, d)
    twice = f.union(f.select(F.concat("path", F.lit(".copy")), "content"))
    tasks = spark.sparkContext.defaultParallelism  # a fixed number: by size Spark would leave small reports, however many, to one task
    twice.select(
        F.regexp_replace("path", "[^A-Za-z0-9]+", "_").alias("name"), F.col("content").alias("value")
    ).repartition(tasks, "name").write.partitionBy("name").option("maxRecordsPerFile", 1).text(path)
    return path


def _drain(stream, spark, mode="append"):
    name = f"s{uuid.uuid4().hex[:12]}"
    q = stream.writeStream.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option(
        "checkpointLocation", f"{shared_dir(spark)}/{name}-log"
    ).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{shared_dir(spark)}/{name}")


REPORTS_SQL = "(SELECT DISTINCT 'DB' || dbname AS dbname, begin_snap FROM wait)"


@query(
    fx.sql(
        "SELECT DISTINCT dbname, instance, begin_snap, n::BIGINT AS copies "
        "FROM (SELECT 'DB' || dbname AS dbname, 'DB' || dbname || instance AS instance, begin_snap, 2 AS n FROM wait)",
        "wait",
    )
)
def s1_file_stream_ingest(spark, d):
    got = _drain(streams.file_stream(spark, _report_files(spark, d) + "/*", "*.txt"), spark)
    return report.metadata(report.report_rows(got)).groupBy("dbname", "instance", "begin_snap").agg(F.count("*").alias("copies"))


@query(
    fx.sql(
        "SELECT DISTINCT 'DB' || dbname AS dbname, 'DB' || dbname || instance AS instance, begin_snap, 1::BIGINT AS copies FROM wait",
        "wait",
    )
)
def s2_content_dedup(spark, d):
    stream = streams.content_dedup(streams.file_stream(spark, _report_files(spark, d) + "/*", "*.txt"))
    return report.metadata(
        report.report_rows(_drain(stream, spark))
    ).groupBy("dbname", "instance", "begin_snap").agg(F.count("*").alias("copies"))


@query(fx.sql("SELECT 'DB' || dbname AS dbname, begin_snap, event, sum(waits)::DOUBLE AS waits FROM wait GROUP BY ALL", "wait"))
def s3_foreachbatch_upsert(spark, d):
    t = _table(spark, "s3", ["dbname"])
    q = streams.upsert_stream(
        streams.file_stream(spark, _report_files(spark, d) + "/*", "*.txt"),
        lambda b: report.facts(b, "foreground_wait_events"),
        t,
        ["dbname", "instance", "begin_snap", "row_hash"],
        f"{shared_dir(spark)}/log-{uuid.uuid4().hex[:12]}",
        once=True,
    )
    q.awaitTermination()
    return t.read().groupBy("dbname", "begin_snap", "event").agg(F.sum("waits").alias("waits"))


_CHAIN_RULES = [
    rules.Rule("c1", "wait", "cl*", "total_waits > 3", "high", "click waits"), rules.Rule("c2", "wait", "*", "total_waits > 2", "medium", "many waits")
]
_CHAIN = """r AS (SELECT 'DB' || dbname AS dbname, 'DB' || dbname || instance AS instance, begin_snap, event, count(*) AS n, min(snap_time) AS since
  FROM wait GROUP BY ALL),
facts AS (SELECT dbname, instance, begin_snap, 'waits' AS source, event AS object, n AS value FROM r),
t AS (SELECT dbname, instance, begin_snap, floor(epoch(min(since)))::BIGINT AS sec FROM r GROUP BY ALL),"""


@query(
    fx.sql(
        "SELECT 'anomaly' AS kind, dbname, instance, begin_snap, object, round(z_score, 6) AS value, severity AS label FROM findings "
        "UNION ALL SELECT 'sum', dbname, instance, begin_snap, event, n, NULL FROM r "
        "UNION ALL SELECT 'finding', dbname, NULL, NULL, min(event), count(*), CASE WHEN event = 'click' AND n > 3 THEN 'c1' ELSE 'c2' END "
        "FROM r WHERE n > 2 GROUP BY dbname, CASE WHEN event = 'click' AND n > 3 THEN 'c1' ELSE 'c2' END",
        "wait",
        ctes=_CHAIN + SNAP_FINDINGS,
    )
)
def s3_load_chain(spark, d):
    """The whole chain in several micro-batches: insert, sums, anomalies, findings."""
    waits, sums, found, advice = (_table(spark, f"s3-{n}", ["dbname"]) for n in ("waits", "sums", "anomalies", "findings"))
    q = streams.chain_stream(
        streams.file_stream(spark, _report_files(spark, d) + "/*", "*.txt", 150),
        lambda b: report.facts(b, "foreground_wait_events"),
        waits,
        ["dbname", "instance", "begin_snap", "row_hash"],
        streams.diagnosis_steps(waits, sums, found, advice, _CHAIN_RULES, {"waits": "waits"}, BACK),
        f"{shared_dir(spark)}/log-{uuid.uuid4().hex[:12]}",
        once=True,
    )
    q.awaitTermination()
    snap, none = ["dbname", "instance", "begin_snap"], F.lit(None)
    rows = lambda t, kind, *cols: t.read().select(F.lit(kind).alias("kind"), *cols)
    out = rows(found, "anomaly", *snap, "object", F.round("z_score", 6).alias("value"), F.col("severity").alias("label"))
    out = out.unionByName(
        rows(sums, "sum", *snap, F.col("event").alias("object"), F.col("total_waits").alias("value"), none.cast("string").alias("label"))
    )
    nothing = [none.cast(out.schema[c].dataType).alias(c) for c in snap[1:]]
    return out.unionByName(
        rows(advice, "finding", "dbname", *nothing, F.col("entity").alias("object"), F.col("hits").cast("double").alias("value"), F.col("rule_id").alias("label"))
    )


@query(fx.sql(f"SELECT hostname, object, day, {FINDING} FROM findings", "host", ctes=HOST_FINDINGS))
def s4_learning_hosts(spark, d):
    """The samples in three loads without any order of time; after the last, the stream's anomalies are those of the backfill."""
    path, log = (f"{shared_dir(spark)}/s4-{n}-{uuid.uuid4().hex[:12]}" for n in ("in", "log"))
    fx.host(spark, d).drop("day").repartition(3).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.learning_host_stream(stream, log, 7, Z, once=True).awaitTermination()
    found = streams.LearnedHosts(spark, log, stream.schema["hostname"].dataType.simpleString()).anomalies()
    return found.select(
        "hostname", "object", "day", *r6("metric_value"), "baseline_n", *r6("baseline_mean", "baseline_stddev"), "fallback", *r6("z_score"), "severity"
    )


@query(fx.sql("""SELECT hostname, object, w AS window_start, round(v, 6) AS metric_value, round(z, 6) AS z_score, CASE
  WHEN abs(z) >= 4 THEN 'critical' WHEN abs(z) >= 3 THEN 'alert' ELSE 'warning' END AS severity FROM (SELECT a.*, CASE
  WHEN coalesce(s, 0) = 0 THEN 0 ELSE (v - m) / s END AS z
  FROM (SELECT hostname, object, date_trunc('day', snap_time) AS w, avg(value) AS v FROM host GROUP BY ALL) a
  JOIN (SELECT hostname, object, avg(value) AS m, stddev_samp(value) AS s FROM host GROUP BY ALL) b USING (hostname, object))
  WHERE abs(z) >= 0.3 AND w < (SELECT date_trunc('day', max(snap_time)) FROM host)""", "host"))
def s4_streaming_host_anomaly(spark, d):
    h = fx.host(spark, d)
    base = h.groupBy("hostname", "object").agg(F.avg("value").alias("baseline_mean"), F.stddev_samp("value").alias("baseline_stddev"))
    schema = fx.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    stream = e.select(
        (F.col("user_id") % 5).alias("hostname"), F.col("ts").alias("snap_time"), F.col("event_type").alias("object"), "value"
    )
    out = _drain(streams.host_anomaly_stream(stream, base, 0.3, "1 day", "1 hour"), spark)
    return out.select(
        "hostname",
        "object",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        *r6("metric_value", "z_score"),
        "severity",
    )
