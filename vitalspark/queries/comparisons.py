"""Joins J5-J18, comparison X7, ranking X8, drill-down X9, X6, X12, memory advice X10, W1, W3, W6."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import joins, rollups, select
from ..plans import compare, drilldown
from . import query
from .anomalies import r6
from .waits import SQL_METRICS, SQL_SUMMARY

TAGS = [(f"{t}_{db}{i}", db, i, a, b, t) for db in "ANR" for i in "FO" for t, a, b in (("before", 3, 20), ("after", 21, 50))]
TAG_SQL = "tags AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{d}', '{i}', {a}, {b}, '{t}')" for n, d, i, a, b, t in TAGS
) + ") v(tag_name, dbname, instance, snap_start, snap_end, tag_type))"


def _tags(spark):
    return spark.createDataFrame(TAGS, "tag_name string, dbname string, instance string, snap_start int, snap_end int, tag_type string")


@query(
    fx.sql(
        "SELECT tag_name, count(*) AS n, round(sum(elapsed), 2) AS elapsed FROM stmt s "
        "JOIN tags t ON t.dbname = s.dbname AND t.instance = s.instance AND begin_snap BETWEEN snap_start AND snap_end GROUP BY tag_name",
        "stmt",
        ctes=TAG_SQL,
    )
)
def j5_interval_tag_join(spark, d):
    return joins.tag_join(fx.stmt(spark, d), _tags(spark)).groupBy("tag_name").agg(
        F.count("*").alias("n"), F.round(F.sum("elapsed"), 2).alias("elapsed")
    )


TAGGED = (
    "tg AS (SELECT s.*, tag_type FROM stmt s JOIN tags t ON t.dbname = s.dbname AND t.instance = s.instance AND begin_snap BETWEEN "
    "snap_start AND snap_end)"
)


@query(
    fx.sql(
        "SELECT dbname, sql_id, round(b, 6) AS before_value, round(a, 6) AS after_value "
        "FROM (SELECT dbname, sql_id, coalesce(x.v, 0) AS b, coalesce(y.v, 0) AS a FROM (SELECT dbname, sql_id, avg(elapsed) AS v "
        "FROM tg WHERE tag_type = 'before' GROUP BY ALL) x FULL JOIN (SELECT dbname, sql_id, avg(elapsed) AS v FROM tg "
        "WHERE tag_type = 'after' GROUP BY ALL) y USING (dbname, sql_id))",
        "stmt",
        ctes=f"{TAG_SQL}, {TAGGED}",
    )
)
def j6_before_after(spark, d):
    t = joins.tag_join(fx.stmt(spark, d), _tags(spark))
    side = lambda k: t.where(F.col("tag_type") == k).groupBy("dbname", "sql_id").agg(F.avg("elapsed").alias("value"))
    return joins.before_after_join(side("before"), side("after"), ["dbname", "sql_id"]).select(
        "dbname", "sql_id", *r6("before_value", "after_value")
    )


@query(
    fx.sql(
        "SELECT sql_id, round(b, 6) AS before_value, round(a, 6) AS after_value, round(a - b, 6) AS delta, round((a - b) / nullif(b, 0) "
        "* 100, 6) AS change_pct FROM (SELECT sql_id, coalesce(avg(elapsed) FILTER (WHERE tag_type = 'before'), 0) AS b, "
        "coalesce(avg(elapsed) FILTER (WHERE tag_type = 'after'), 0) AS a FROM tg GROUP BY sql_id) WHERE b >= 34000 OR a >= 34000",
        "stmt",
        ctes=f"{TAG_SQL}, {TAGGED}",
    )
)
def x7_compare_periods(spark, d):
    out = compare.compare_periods(fx.stmt(spark, d), _tags(spark), ["sql_id"], F.col("elapsed"), 34000, 6)
    return out.select("sql_id", *r6("before_value", "after_value", "delta", "change_pct"))


@query(
    fx.sql(
        "SELECT w.hostname, w.day, w.object, round(w.total, 4) AS total, h.snap_time, h.value "
        "FROM (SELECT hostname, day, object, sum(value) AS total FROM host GROUP BY ALL) w "
        "LEFT JOIN (SELECT hostname, object, max(snap_time) AS snap_time, arg_max(value, snap_time) AS value FROM host "
        "WHERE object <> 'view' GROUP BY ALL) h USING (hostname, object)",
        "host",
    )
)
def j8_latest_lateral(spark, d):
    h = fx.host(spark, d)
    left = h.groupBy("hostname", "day", "object").agg(F.round(F.sum("value"), 4).alias("total"))
    return joins.latest_lateral(left, h.where("object <> 'view'"), ["hostname", "object"], F.col("snap_time"), ["snap_time", "value"])


@query(
    fx.sql(
        "SELECT tag_name, t.dbname, snap_start AS begin_snap, snap_time FROM tags t "
        "LEFT JOIN (SELECT dbname, instance, begin_snap, min(snap_time) AS snap_time FROM stmt "
        "GROUP BY ALL) s ON s.dbname = t.dbname AND s.instance = t.instance AND s.begin_snap = t.snap_start",
        "stmt",
        ctes=TAG_SQL,
    )
)
def j9_scalar_lookup(spark, d):
    t = _tags(spark).withColumnRenamed("snap_start", "begin_snap")
    return joins.scalar_lookup(
        t, fx.stmt(spark, d), ["dbname", "instance", "begin_snap"], "snap_time"
    ).select("tag_name", "dbname", "begin_snap", "snap_time")


@query(
    fx.sql(
        "SELECT h.hostname, h.object, h.snap_time, h.value, s.begin_snap::DOUBLE AS begin_snap FROM host h "
        "ASOF LEFT JOIN (SELECT hostname, min(snap_time) AS snap_start, floor(epoch(date_trunc('day', snap_time)) / 259200)::BIGINT AS "
        "begin_snap FROM host WHERE object = 'click' GROUP BY hostname, floor(epoch(date_trunc('day', snap_time)) / 259200)::BIGINT) s "
        "ON h.hostname = s.hostname AND h.snap_time >= s.snap_start",
        "host",
    )
)
def j10_snapshot_to_hostlog(spark, d):
    h = fx.host(spark, d)
    bucket = F.floor(F.unix_date(F.to_date("snap_time")) / 3).alias("begin_snap")
    snaps = h.where("object = 'click'").groupBy("hostname", bucket).agg(F.min("snap_time").alias("snap_start"))
    return joins.asof_snapshot(h, snaps, ["hostname"]).select(
        "hostname", "object", "snap_time", "value", F.col("begin_snap").cast("double").alias("begin_snap")
    )


OBJECT_MAP = r"""nt AS (SELECT sql_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(sql_text), '''[^'']*''',
  '', 'g'), '--[^\n]*', ' ', 'g'), '/\*(.|\n)*?\*/', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM sqltext),
om AS (SELECT DISTINCT sql_id, nullif(p[1], '') AS owner, p[2] AS object
  FROM (SELECT sql_id, [regexp_extract(m,
  '(?:from|join|insert\s+into|update|delete\s+from|merge\s+into)\s+(?:([a-z][a-z0-9_$#]*)\.)?([a-z][a-z0-9_$#]*)', 1), regexp_extract(m,
  '(?:from|join|insert\s+into|update|delete\s+from|merge\s+into)\s+(?:([a-z][a-z0-9_$#]*)\.)?([a-z][a-z0-9_$#]*)', 2)] AS p
  FROM (SELECT sql_id, unnest(regexp_extract_all(t,
  '\b(?:from|join|insert\s+into|update|delete\s+from|merge\s+into)\s+(?:([a-z][a-z0-9_$#]*)\.)?([a-z][a-z0-9_$#]*)')) AS m FROM nt))
  WHERE p[2] NOT IN ('select', 'set', 'dual', 'table', 'lateral', 'only'))"""


@query(fx.sql("SELECT sql_id, owner, object, owner IS NOT NULL AS has_owner FROM om", "sqltext", ctes=OBJECT_MAP))
def x12_sql_object_map(spark, d):
    return drilldown.sql_object_map(fx.sqltext(spark, d))


SEGOBJ = "so AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) AS owner, 't' || (p_partkey % 97) AS object FROM part)"


def _segment_objects(spark, d):
    p = fx.table(spark, d, "part")
    return p.select(
        F.lower(F.regexp_replace("p_brand", "#", "_")).alias("owner"),
        F.concat(F.lit("t"), (F.col("p_partkey") % 97).cast("string")).alias("object"),
    ).distinct()


@query(
    fx.sql(
        "SELECT sql_id, so.owner, so.object FROM om JOIN so ON om.object = so.object AND (om.owner = so.owner OR om.owner IS NULL)",
        "sqltext",
        ctes=f"{OBJECT_MAP}, {SEGOBJ}",
    )
)
def j11_text_object_bridge(spark, d):
    m = drilldown.sql_object_map(fx.sqltext(spark, d)).drop("has_owner")
    return joins.object_bridge(m, _segment_objects(spark, d)).select("sql_id", "owner", "object")


CO = (
    "sq AS (SELECT dbname, instance, begin_snap, sql_id, avg(elapsed) / 1000 AS score FROM stmt "
    "GROUP BY ALL), sg AS (SELECT dbname, instance, begin_snap, obj_type AS owner, owner AS object_name, avg(value) AS score FROM seg "
    "WHERE metric = 'logical_reads' GROUP BY ALL), sb AS (SELECT dbname, instance, begin_snap, object_name, avg(score) AS score FROM sg "
    "GROUP BY ALL), wt AS (SELECT dbname, instance, begin_snap, 'parse ' || parses AS event, avg(executions) AS score FROM stmt "
    "GROUP BY ALL)"
)


def _scored(spark, d):
    key = ["dbname", "instance", "begin_snap"]
    s = fx.stmt(spark, d)
    sq = s.groupBy(*key, "sql_id").agg((F.avg("elapsed") / 1000).alias("score"))
    sg = fx.seg(spark, d).where("metric = 'logical_reads'").groupBy(
        *key, F.col("obj_type").alias("owner"), F.col("owner").alias("object_name")
    ).agg(F.avg("value").alias("score"))
    wt = s.groupBy(*key, F.concat(F.lit("parse "), F.col("parses").cast("string")).alias("event")).agg(F.avg("executions").alias("score"))
    return sq, sg, wt


@query(
    fx.sql(
        "SELECT sql_id, object_name, round(sum(a.score * b.score), 7) AS signal, count(*) AS snaps FROM sq a "
        "JOIN sb b USING (dbname, instance, begin_snap) GROUP BY ALL",
        "stmt",
        "seg",
        ctes=CO,
    )
)
def j12_cooccurrence(spark, d):
    sq, sg, _ = _scored(spark, d)
    sb = sg.groupBy("dbname", "instance", "begin_snap", "object_name").agg(F.avg("score").alias("score"))
    return joins.cooccurrence(sq, sb).withColumn("signal", F.round("signal", 7))


CO_PARTS = CO + (
    ", sp AS (SELECT dbname, instance, begin_snap, object_name, avg(value) AS score FROM seg WHERE metric = 'logical_reads' GROUP BY ALL)"
)


@query(
    fx.sql(
        "SELECT sql_id, object_name, round(sum(a.score * b.score), 7) AS signal, count(*) AS snaps FROM sq a "
        "JOIN sp b USING (dbname, instance, begin_snap) GROUP BY ALL ORDER BY sum(a.score * b.score) DESC, sql_id, object_name LIMIT 100",
        "stmt",
        "seg",
        ctes=CO_PARTS,
    )
)
def j12_cooccurrence_top(spark, d):
    """The best pairs of statements and single parts; all pairs of these would be too many."""
    sq, _, _ = _scored(spark, d)
    sp = fx.seg(spark, d).where("metric = 'logical_reads'").groupBy("dbname", "instance", "begin_snap", "object_name").agg(F.avg("value").alias("score"))
    return joins.cooccurrence_top(sq, sp, 100).withColumn("signal", F.round("signal", 7))


#: What goes with a focus, and the statements that name an object, as DuckDB text.
TOGETHER = """SELECT * FROM (SELECT '{section}' AS section, {item}::VARCHAR AS item, round(sum(b.score * w), 4) AS amount
  FROM {side} b JOIN (SELECT dbname, instance, begin_snap, sum(score) AS w FROM {own} WHERE {focus}
  GROUP BY ALL) USING (dbname, instance, begin_snap)
  GROUP BY ALL ORDER BY sum(b.score * w) DESC, item LIMIT 10)"""
NAMED_BY = """SELECT * FROM (SELECT 'segment_text' AS section, object_name::VARCHAR AS item, round(max(m), 4) AS amount
  FROM (SELECT owner, object_name, avg(score) AS m FROM sg GROUP BY ALL) WHERE object_name IN (SELECT brand FROM br WHERE sql_id = 4)
  GROUP BY object_name ORDER BY max(m) DESC, item LIMIT 10)"""
NAMING = """SELECT * FROM (SELECT 'sql_text' AS section, sql_id::VARCHAR AS item, round(avg(score), 4) AS amount FROM sq
  WHERE sql_id IN (SELECT sql_id FROM br WHERE {brand}) {more} GROUP BY sql_id ORDER BY avg(score) DESC, item LIMIT 10)"""
BRIDGE = "br AS (SELECT DISTINCT l_suppkey AS sql_id, p_brand AS brand FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _together(name: str, own: str, focus: str) -> str:
    side, item = {"sql": ("sq", "sql_id"), "segment": ("sg", "object_name"), "wait": ("wt", "event")}[name]
    return TOGETHER.format(section=f"{name}_together", item=item, side=side, own=own, focus=focus)


def _drawer(*parts: str) -> str:
    return fx.sql(" UNION ALL ".join(parts), "stmt", "seg", ctes=f"{CO}, {BRIDGE}")


FOCUS_SQL = [
    _together("segment", "sq", "sql_id = 4"),
    _together("wait", "sq", "sql_id = 4"),
    NAMED_BY,
    NAMING.format(brand="brand IN (SELECT brand FROM br WHERE sql_id = 4)", more="AND sql_id <> 4"),
]
WITH_WAIT = _together("segment", "wt", "event = 'parse 4'")


def _focus(spark, d, focus, value):
    sq, sg, wt = _scored(spark, d)
    li, part = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    names = li.join(part, li["l_partkey"] == part["p_partkey"])
    names = names.select(F.col("l_suppkey").alias("sql_id"), F.lit(None).cast("string").alias("owner"), F.lower("p_brand").alias("object"))
    return drilldown.focus_drilldown(sq, sg, wt, names.distinct(), focus, value)


@query(_drawer(*FOCUS_SQL))
def x9_focus_drilldown(spark, d):
    return _focus(spark, d, "sql", 4).withColumn("amount", F.round("amount", 4))


@query(
    _drawer(
        _together("sql", "sg", "object_name = 'Brand#12'"),
        _together("wait", "sg", "object_name = 'Brand#12'"),
        NAMING.format(brand="brand = 'Brand#12'", more=""),
    )
)
def x9_focus_segment(spark, d):
    return _focus(spark, d, "segment", "Brand#12").withColumn("amount", F.round("amount", 4))


@query(
    _drawer(
        _together("sql", "wt", "event = 'parse 4'"), WITH_WAIT, NAMING.format(brand=f"brand IN (SELECT item FROM ({WITH_WAIT}))", more="")
    )
)
def x9_focus_wait(spark, d):
    return _focus(spark, d, "wait", "parse 4").withColumn("amount", F.round("amount", 4))


DRAWER_RULES = [("sql", "*", "look at the plan"), ("sql", "4", "use bind variables"), ("wait", "*", "look at the event")]
DRAWER_TEXT = """SELECT 1 AS ord, 'Focus' AS section, 'sql: 4' AS value UNION ALL SELECT 9, 'Recommendation', 'use bind variables'
  UNION ALL
SELECT ord, title, string_agg('• ' || item || ' [' || printf('%.2f', round(amount, 2)) || ']', chr(10) ORDER BY amount DESC, item)
FROM ({found}) f JOIN (VALUES {titles}) t(name, ord, title) ON t.name = f.section GROUP BY ord, title"""


@query(
    _drawer(
        DRAWER_TEXT.format(
            found=" UNION ALL ".join(FOCUS_SQL), titles=", ".join(f"('{n}', {at}, '{t}')" for n, (at, t) in drilldown.TITLES.items())
        )
    )
)
def x9_drilldown_text(spark, d):
    rules = spark.createDataFrame(DRAWER_RULES, "category string, rule_key string, rule_text string")
    return drilldown.drilldown_text(_focus(spark, d, "sql", 4).withColumn("amount", F.round("amount", 4)), "sql", 4, rules)


@query(
    fx.sql(
        "SELECT s.object_name, s.owner, s.n, coalesce(m.blevel, a.blevel) AS m_blevel FROM (SELECT object_name, CASE "
        "WHEN object_name % 2 = 0 THEN owner ELSE 'nobody' END AS owner, count(*) AS n FROM seg GROUP BY ALL) s "
        "LEFT JOIN meta m ON upper(m.owner) = upper(s.owner) AND m.object_name = s.object_name "
        "LEFT JOIN meta a ON a.object_name = s.object_name",
        "seg",
        "meta",
    )
)
def j13_metadata_enrich(spark, d):
    s = fx.seg(spark, d).withColumn(
        "owner", F.when(F.col("object_name") % 2 == 0, F.col("owner")).otherwise("nobody")
    ).groupBy("object_name", "owner").agg(F.count("*").alias("n"))
    return joins.metadata_enrich(s, fx.meta(spark, d), ["blevel"])


@query(
    fx.sql(
        "SELECT a.hostname, a.object, round(c, 6) AS current_value, round(b, 6) AS baseline "
        "FROM (SELECT hostname, object, avg(value) AS c FROM host WHERE day >= '2024-01-20' GROUP BY ALL) a "
        "JOIN (SELECT hostname, object, avg(value) AS b FROM host WHERE day < '2024-01-20' GROUP BY ALL "
        "HAVING count(*) >= 3) b USING (hostname, object)",
        "host",
    )
)
def j14_baseline_join(spark, d):
    h = fx.host(spark, d)
    cut = F.lit("2024-01-20").cast("date")
    now = h.where(F.col("day") >= cut).groupBy("hostname", "object").agg(F.avg("value").alias("current_value"))
    base = h.where(F.col("day") < cut).groupBy("hostname", "object").agg(
        F.avg("value").alias("baseline"), F.count("*").alias("n")
    ).where("n >= 3").drop("n")
    return now.join(base, ["hostname", "object"]).select("hostname", "object", *r6("current_value", "baseline"))


@query(
    fx.sql(
        "SELECT sql_id, round(elapsed, 2) AS elapsed, round(cpu, 3) AS cpu, parses FROM (SELECT sql_id, sum(elapsed) AS elapsed "
        "FROM stmt GROUP BY sql_id ORDER BY elapsed DESC, sql_id LIMIT 20) LEFT JOIN (SELECT sql_id, sum(cpu) AS cpu FROM stmt "
        "WHERE parses > 2 GROUP BY sql_id) USING (sql_id) LEFT JOIN (SELECT sql_id, sum(parses)::BIGINT AS parses FROM stmt "
        "GROUP BY sql_id) USING (sql_id)",
        "stmt",
    )
)
def j15_driver_left_fetch(spark, d):
    s = fx.stmt(spark, d)
    top = s.groupBy("sql_id").agg(F.sum("elapsed").alias("elapsed"))
    others = {
        "cpu": s.where("parses > 2").groupBy("sql_id").agg(F.sum("cpu").alias("cpu")),
        "parses": s.groupBy("sql_id").agg(F.sum("parses").alias("parses")),
    }
    out = joins.driver_left_fetch(top, others, "sql_id", 20, F.desc("elapsed"), F.col("sql_id"))
    return out.select("sql_id", F.round("elapsed", 2).alias("elapsed"), F.round("cpu", 3).alias("cpu"), "parses")


@query(
    fx.sql(
        "SELECT event, count(*) AS n, sum((pct > low AND pct <= high)::INT)::BIGINT AS between_n "
        "FROM wait, (SELECT 5.0 AS low, 12.0 AS high) GROUP BY event",
        "wait",
    )
)
def j16_cross_params(spark, d):
    w = joins.with_params(fx.wait(spark, d), low=5.0, high=12.0)
    return w.groupBy("event").agg(
        F.count("*").alias("n"), F.count_if((F.col("pct") > F.col("low")) & (F.col("pct") <= F.col("high"))).alias("between_n")
    )


@query(
    "SELECT min(url) AS path, md5(html) AS hash FROM pages WHERE url NOT IN (SELECT url FROM pages "
    "WHERE url LIKE '%/fr/%' OR url LIKE '%/de/%') AND md5(html) NOT IN (SELECT md5(html) FROM pages WHERE url LIKE '%/fr/%') "
    "GROUP BY md5(html)"
)
def j17_ledger_anti(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.col("url").alias("path"), F.md5("html").alias("hash"))
    ledger = p.where("path like '%/fr/%' or path like '%/de/%'").withColumn(
        "state", F.when(F.col("path").like("%/fr/%"), "done").otherwise("failed")
    )
    return joins.ledger_anti(p.drop("page_id"), ledger).select("path", "hash")


STEPS = (
    "(SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey "
    "ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS step_id, l_returnflag AS op, l_linestatus AS ob, l_linenumber AS "
    "line FROM lineitem)"
)
MATCH = f"""st AS {STEPS}, x AS (SELECT plan, step_id, op, ob, row_number() OVER (PARTITION BY plan, op, ob ORDER BY step_id) AS n
  FROM st WHERE line <> 3), y AS (SELECT plan, step_id, op, ob, row_number() OVER (PARTITION BY plan, op, ob ORDER BY step_id) AS n
  FROM st WHERE line <> 5),
b AS (SELECT coalesce(x.plan, y.plan) AS plan, x.step_id AS sb, y.step_id AS sa FROM x
  FULL JOIN y ON x.plan = y.plan AND x.op = y.op AND x.ob = y.ob AND x.n = y.n),
l AS (SELECT plan, sb, row_number() OVER (PARTITION BY plan ORDER BY sb) AS n FROM b
  WHERE sa IS NULL), r AS (SELECT plan, sa, row_number() OVER (PARTITION BY plan ORDER BY sa) AS n FROM b WHERE sb IS NULL),
m AS (SELECT plan, sb AS step_before, sa AS step_after, 'same' AS how FROM b WHERE sb IS NOT NULL AND sa IS NOT NULL UNION ALL
  SELECT coalesce(l.plan, r.plan), sb, sa, CASE WHEN sa IS NULL THEN 'removed' WHEN sb IS NULL THEN 'added' ELSE 'moved' END FROM l
  FULL JOIN r ON l.plan = r.plan AND l.n = r.n)"""


def _steps(spark, d):
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    return fx.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("plan"),
        n.alias("step_id"),
        F.col("l_returnflag").alias("operation"),
        F.col("l_linestatus").alias("object_name"),
        F.col("l_linenumber").alias("line"),
    )


@query("WITH " + MATCH + " SELECT plan, step_before::DOUBLE AS step_before, step_after::DOUBLE AS step_after, how FROM m")
def j18_plan_step_match(spark, d):
    s = _steps(spark, d)
    out = joins.step_match(s.where("line <> 3"), s.where("line <> 5"))
    return out.withColumns({c: F.col(c).cast("double") for c in ("step_before", "step_after")})


@query(
    "WITH st AS "
    + STEPS
    + " SELECT plan, step_id, op, ob, row_number() OVER (PARTITION BY plan, op, ob ORDER BY step_id)::INT AS n FROM st"
)
def w6_occurrence_number(spark, d):
    s = _steps(spark, d).withColumnsRenamed({"operation": "op", "object_name": "ob"})
    return s.select("plan", "step_id", "op", "ob", select.occurrence_number(["plan", "op", "ob"], "step_id").alias("n"))


RULES = [("click", "A", "click in A"), ("click", "*", "any click"), ("ERROR", "*", "any error"), ("view", "B", "view in B")]


@query(
    fx.sql(
        "SELECT event, dbname, CASE WHEN event = 'click' AND dbname = 'a' THEN 'click in A' WHEN event = 'click' THEN 'any click' "
        "WHEN event = 'error' THEN 'any error' WHEN event = 'view' AND dbname = 'b' THEN 'view in B' END AS rule_text, n "
        "FROM (SELECT event, CASE dbname WHEN 0 THEN 'a' ELSE 'b' END AS dbname, count(*) AS n FROM wait GROUP BY ALL)",
        "wait",
    )
)
def x6_rule_text_pick(spark, d):
    w = fx.wait(spark, d).withColumn(
        "dbname", F.when(F.col("dbname") == 0, "a").otherwise("b")
    ).groupBy("event", "dbname").agg(F.count("*").alias("n"))
    return drilldown.rule_text_pick(
        w, spark.createDataFrame(RULES, "category string, rule_key string, rule_text string"), "event", "dbname"
    )


@query(
    fx.sql(
        """SELECT m.dbname, m.sql_id, round(m.s, 6) AS mean_score, round(coalesce(least(100, greatest(0, 100 * (m.s - p10) /
  nullif(p90 - p10, 0))), 0), 6) AS normalised, CASE WHEN m.s >= p90 THEN 'red' WHEN m.s >= p70 THEN 'orange'
  WHEN m.s >= p40 THEN 'yellow' ELSE 'green' END AS rag
FROM (SELECT dbname, sql_id, avg(score) AS s FROM ss GROUP BY ALL) m
  JOIN (SELECT dbname, quantile_cont(s, 0.1) AS p10, quantile_cont(s, 0.4) AS p40, quantile_cont(s, 0.7) AS p70, quantile_cont(s, 0.9) AS
  p90 FROM (SELECT dbname, sql_id, avg(score) AS s FROM ss GROUP BY ALL) GROUP BY dbname) q ON q.dbname = m.dbname""",
        "stmt",
        ctes=SQL_SUMMARY,
    )
)
def x8_rag_ranking(spark, d):
    out = compare.rag_ranking(rollups.sql_summary(fx.stmt(spark, d), SQL_METRICS), "sql_id")
    return out.select("dbname", "sql_id", *r6("mean_score", "normalised"), "rag")


CURVE = (
    "cv AS (SELECT p_brand AS dbname, p_size * 100 AS size_mb, CASE "
    "WHEN p_size = 20 THEN 1.0 ELSE p_size / 20.0 END::DOUBLE AS factor, avg(1e6 / (1 + p_size) + p_partkey % 3) AS db_time, "
    "sum(p_partkey)::BIGINT AS reads FROM part GROUP BY p_brand, p_size)"
)
PLATEAU = (
    "pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dbname ORDER BY size_mb) AS n "
    "FROM (SELECT *, (lag(db_time) OVER w - db_time) / nullif(lag(db_time) OVER w, 0) AS gain FROM cv WINDOW w AS (PARTITION BY dbname "
    "ORDER BY size_mb)) WHERE gain < 0.025) WHERE n = 1)"
)


def _curve(spark, d):
    p = fx.table(spark, d, "part")
    return p.groupBy(
        F.col("p_brand").alias("dbname"), (F.col("p_size") * 100).alias("size_mb"), (F.col("p_size") / 20).alias("factor")
    ).agg(F.avg(1e6 / (1 + F.col("p_size")) + F.col("p_partkey") % 3).alias("db_time"), F.sum("p_partkey").alias("reads"))


@query(fx.sql("SELECT dbname, size_mb, round(gain, 9) AS gain FROM pl", ctes=f"{CURVE}, {PLATEAU}"))
def w1_plateau_detect(spark, d):
    return compare.plateau(
        _curve(spark, d), ["dbname"], "size_mb", "db_time", 0.025
    ).select("dbname", "size_mb", F.round("gain", 9).alias("gain"))


@query(
    fx.sql(
        "SELECT dbname, size_mb, CASE WHEN count(*) OVER (PARTITION BY dbname) <= 1 THEN 70 "
        "WHEN count(*) OVER (PARTITION BY dbname) <= 4 THEN 85 ELSE 95 END AS confidence FROM cv",
        ctes=CURVE,
    )
)
def w3_count_over_all(spark, d):
    return compare.confidence(_curve(spark, d), ["dbname"]).select("dbname", "size_mb", "confidence")


@query(fx.sql("""SELECT c.dbname, c.size_mb AS current_mb, p.size_mb AS plateau_mb, greatest(0.0, p.size_mb - c.size_mb)::DOUBLE AS
  need_mb, round((c.db_time - p.db_time) / nullif(c.db_time, 0) * 100, 6) AS gain_pct, c.reads - p.reads AS reads_saved, free_mb::DOUBLE
  AS free_mb,
CASE WHEN free_mb IS NULL THEN 'unknown' WHEN greatest(0, p.size_mb - c.size_mb) <= free_mb * 0.5 THEN 'low'
  WHEN greatest(0, p.size_mb - c.size_mb) <= free_mb THEN 'medium' ELSE 'high' END AS risk,
CASE WHEN p.size_mb IS NULL THEN 'still rising' WHEN p.size_mb <= c.size_mb THEN 'sufficient'
  WHEN p.size_mb - c.size_mb > coalesce(free_mb, 0) THEN 'no room' ELSE 'increase' END AS verdict
FROM (SELECT * FROM cv WHERE factor = 1) c LEFT JOIN pl p ON p.dbname = c.dbname
  LEFT JOIN (SELECT p_brand AS dbname, max(p_size) FILTER (WHERE p_name ILIKE '%red%') * 40 AS free_mb FROM part
  GROUP BY ALL) o ON o.dbname = c.dbname""", ctes=f"{CURVE}, {PLATEAU}"))
def x10_memory_advice(spark, d):
    os = rollups.conditional_pivot(
        fx.table(spark, d, "part").withColumnRenamed("p_brand", "dbname"), ["dbname"], "p_name", "p_size", {"free": "%red%"}
    ).select("dbname", (F.col("free") * 40).alias("free_mb"))
    out = compare.memory_advice(_curve(spark, d), os, ["dbname"], 0.025)
    return out.select(
        "dbname",
        "current_mb",
        "plateau_mb",
        "need_mb",
        *r6("gain_pct"),
        "reads_saved",
        F.col("free_mb").cast("double").alias("free_mb"),
        "risk",
        "verdict",
    )
