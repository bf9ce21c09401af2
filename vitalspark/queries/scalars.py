"""Scalar functions F1-F26 applied to columns of the test tables, or to texts that Spark writes from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import scalars as S
from . import query


def _t(name):
    return lambda spark, d: fx.table(spark, d, name)


lineitem, events, part, orders = map(_t, ("lineitem", "events", "part", "orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def f1_clean_number(spark, d):
    text = F.when(
        F.col("o_orderkey") % 7 == 0,
        F.element_at(F.array(F.lit(" "), F.lit("n/a"), F.lit("nan")), (F.col("o_orderkey") % 3 + 1).cast("int")),
    ).otherwise(F.concat(F.lit(" "), F.format_number("o_totalprice", 2)))
    return orders(spark, d).select("o_orderkey", S.clean_number(text).alias("v"))


@query(
    "SELECT event_id, round(value * CASE event_id % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 1 END, 9) AS ms "
    "FROM events"
)
def f2_to_ms(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("us", "ms", "s", "", "parsecs!"))), (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, d).select("event_id", F.round(S.to_ms(F.concat(F.col("value").cast("string"), unit)), 9).alias("ms"))


@query(
    "SELECT event_id, round(value * CASE event_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 1 "
    "WHEN 2 THEN 1 / 1024.0::DOUBLE ELSE 1 END, 9) AS mb FROM events"
)
def f3_to_mb(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("G", "M", "K", ""))), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, d).select("event_id", F.round(S.to_mb(F.concat(F.col("value").cast("string"), unit)), 9).alias("mb"))


@query("SELECT event_id, round(value * CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END, 6) AS n FROM events")
def f4_to_count(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("K", "M", ""))), (F.col("event_id") % 3 + 1).cast("int"))
    return events(spark, d).select("event_id", F.round(S.to_count(F.concat(F.col("value").cast("string"), unit)), 6).alias("n"))


@query("SELECT event_id, md5(concat_ws('|', event_id::VARCHAR, event_type, 'None', user_id::VARCHAR)) AS row_hash FROM events")
def f5_row_hash(spark, d):
    e = events(spark, d).select("event_id", "user_id", "event_type", F.lit(None).cast("string").alias("note"))
    return e.select("event_id", S.row_hash(["user_id", "note", "event_type", "event_id"]).alias("row_hash"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_name END AS v FROM part")
def f6_sanitize(spark, d):
    word = F.element_at(F.array(*map(F.lit, S.NULL_WORDS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part(spark, d).select("p_partkey", S.sanitize(F.when(F.col("p_partkey") % 5 == 0, word).otherwise(F.col("p_name"))).alias("v"))


@query(
    "SELECT p_partkey, p_size * CASE p_partkey % 3 WHEN 0 THEN 1000.0 ELSE 1.0 END AS size_v, CASE p_partkey % 3 "
    "WHEN 0 THEN NULL ELSE p_size::DOUBLE END AS cost_compat, p_size * CASE p_partkey % 3 WHEN 0 THEN 1000.0 ELSE 1.0 END AS cost_v "
    "FROM part"
)
def f7_plan_size_cost(spark, d):
    s = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "K").otherwise(""))
    c = F.concat(s, F.when(F.col("p_partkey") % 3 == 1, " (12)").otherwise(""))
    return part(spark, d).select(
        "p_partkey", S.plan_size(s).alias("size_v"), S.plan_cost(c, compat=True).alias("cost_compat"), S.plan_cost(c).alias("cost_v")
    )


@query(
    "SELECT event_id, round(CASE WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - 50) / sd END, 9) AS z, CASE WHEN abs(CASE "
    "WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - 50) / sd END) >= 4 THEN 'critical' WHEN abs(CASE "
    "WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - 50) / sd END) >= 3 THEN 'alert' WHEN abs(CASE "
    "WHEN sd = 0 OR sd IS NULL THEN 0 ELSE (value - 50) / sd END) >= 1.5 THEN 'warning' END AS severity FROM (SELECT *, "
    "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL WHEN 2 THEN 12.5 ELSE 30 END::DOUBLE AS sd FROM events)"
)
def f8_f9_z_score(spark, d):
    n = F.col("event_id") % 4
    e = events(spark, d).withColumn("sd", F.when(n == 0, 0.0).when(n == 2, 12.5).when(n == 3, 30.0))
    z = S.z_score("value", F.lit(50.0), "sd")
    return e.select("event_id", F.round(z, 9).alias("z"), S.z_severity(z).alias("severity"))


@query(
    "SELECT event_id, CASE WHEN value / 5 >= 20 THEN 5 WHEN value / 5 >= 10 THEN 4 WHEN value / 5 >= 5 THEN 3 "
    "WHEN value / 5 >= 2 THEN 2 ELSE 1 END AS score5, round(0.5 * value / 5 + 0.3 * value + 0.2 * 3, 9) AS blend, round(0.7 * value / 5 "
    "+ 0.2 * value / 100 + 0.1 * 3 / 10, 9) AS blend2 FROM events"
)
def f10_f12_wait_scores(spark, d):
    pct = F.col("value") / 5
    return events(spark, d).select(
        "event_id",
        S.wait_score(pct).alias("score5"),
        S.wait_blend(pct, "value", F.lit(3.0), 9).alias("blend"),
        S.wait_summary_blend(pct, "value", F.lit(3.0), 9).alias("blend2"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.25 * l_extendedprice + 0.25 * coalesce(nullif(l_tax, 0), 0) + 0.15 "
    "* l_quantity / 1e4 + 0.05 * l_linenumber / 1e3, 8) AS score FROM lineitem"
)
def f13_sql_score(spark, d):
    li = lineitem(spark, d).withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.sql_score({"elapsed": "l_extendedprice", "cpu": "l_tax", "gets": "l_quantity", "parses": "l_linenumber"}, 8).alias("score"),
    )


_WIDE = {"physical_reads": "l_extendedprice", "logical_reads": "l_quantity", "direct_reads": "l_tax", "row_lock_waits": "l_discount"}


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.15 * l_extendedprice + 0.10 * l_quantity + 0.10 * l_tax + 0.10 * "
    "l_discount, 8) AS weighted, round(2 * l_extendedprice + l_quantity + 2 * l_tax + l_discount, 6) AS plain FROM lineitem"
)
def f14_f15_segment_scores(spark, d):
    li = lineitem(spark, d).withColumns({k: F.col(c) for k, c in _WIDE.items()})
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        S.segment_score_weighted(list(_WIDE), 8).alias("weighted"),
        S.segment_score_sum(list(_WIDE), 6).alias("plain"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_tax - l_discount) / nullif(l_discount, 0) * 100, 6) AS change "
    "FROM lineitem"
)
def f16_pct_change(spark, d):
    return lineitem(spark, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.pct_change("l_discount", "l_tax", 6).alias("change")
    )


@query(
    "SELECT event_id, CASE WHEN value >= 80 THEN 'red' WHEN value BETWEEN 41 AND 79 THEN 'orange' "
    "WHEN value BETWEEN 11 AND 40 THEN 'yellow' ELSE 'green' END AS rag FROM events"
)
def f17_rag_fixed(spark, d):
    return events(spark, d).select("event_id", S.rag_fixed("value").alias("rag"))


@query(
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS sort_key "
    "FROM orders"
)
def f18_severity_order(spark, d):
    name = F.split_part("o_orderpriority", F.lit("-"), F.lit(2))
    return orders(spark, d).select("o_orderkey", S.severity_order(F.when(name == "URGENT", "Critical").otherwise(name)).alias("sort_key"))


@query(
    "SELECT event_id, CASE WHEN value > 20 THEN 'critical' WHEN value > 10 THEN 'high' "
    "WHEN value > 5 THEN 'medium' ELSE 'low' END AS wait, CASE WHEN value * 20 > 3600 THEN 'critical' WHEN value * 20 > 300 THEN 'high' "
    "WHEN value * 20 > 60 THEN 'medium' ELSE 'low' END AS stmt, CASE WHEN value >= 85 THEN 'critical' WHEN value >= 60 THEN 'warning' "
    "WHEN value * 2 >= 50 THEN 'slow' ELSE 'ok' END AS disk FROM events"
)
def f19_severity_by_threshold(spark, d):
    v = F.col("value")
    return events(spark, d).select(
        "event_id", S.wait_severity(v).alias("wait"), S.sql_severity(v * 20).alias("stmt"), S.disk_status(v, v * 2).alias("disk")
    )


@query(
    "SELECT event_id, CASE WHEN n = 0 THEN 'not executed' WHEN value / greatest(n, 1) * 1000 < 10 THEN 'good' "
    "WHEN value / greatest(n, 1) * 1000 < 100 THEN 'acceptable' "
    "WHEN value / greatest(n, 1) * 1000 < 1000 THEN 'slow' ELSE 'very slow' END AS class, round((1 - n / greatest(value, 1)) * 100, 6) "
    "AS hit FROM (SELECT *, ((event_id * 7919) % 50000)::DOUBLE * (event_id % 3) AS n FROM events)"
)
def f20_f21_perf_class(spark, d):
    n = (F.col("event_id") * 7919 % 50000).cast("double") * (F.col("event_id") % 3)
    return events(spark, d).select("event_id", S.sql_perf_class("value", n).alias("class"), S.cache_hit_pct(n, "value", 6).alias("hit"))


@query(
    fx.sql(
        "SELECT sql_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(sql_text), '''[^'']*''', '', 'g'), "
        "'--[^\\n]*', ' ', 'g'), '/\\*(.|\\n)*?\\*/', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM sqltext",
        "sqltext",
    )
)
def f22_sql_normalise(spark, d):
    return fx.sqltext(spark, d).select("sql_id", S.sql_normalise("sql_text").alias("text"))


@query(
    "SELECT o_orderkey, o_orderkey || ' - ' || strftime(o_orderdate, '%Y-%m-%d %H:%M') AS label, o_orderkey::INT AS snap, "
    "strftime(o_orderdate, '%d-%b-%Y') AS day_label, o_orderdate::DATE AS day, left(o_orderpriority, 3) AS short FROM orders"
)
def f23_labels(spark, d):
    o = orders(spark, d).withColumn("label", S.snap_label("o_orderkey", "o_orderdate"))
    return o.select(
        "o_orderkey",
        "label",
        S.snap_of_label("label").alias("snap"),
        S.day_label("o_orderdate").alias("day_label"),
        S.day_of_label(S.day_label("o_orderdate")).alias("day"),
        F.left("o_orderpriority", F.lit(3)).alias("short"),
    )


@query(
    "SELECT p_partkey, CASE WHEN pat = '*' THEN true WHEN pat LIKE '%*' THEN starts_with(lower(p_type), lower(left(pat, length(pat) - "
    "1))) ELSE lower(p_type) = lower(pat) END AS hit FROM (SELECT *, ['*', 'Econ*', 'standard', 'X*'][p_partkey % 4 + 1] AS pat "
    "FROM part)"
)
def f24_wildcard_match(spark, d):
    pat = F.element_at(F.array(*map(F.lit, ("*", "Econ*", "standard", "X*"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return part(spark, d).select("p_partkey", S.wildcard_match("p_type", pat).alias("hit"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' | ' || p_brand ELSE p_name END AS steps FROM part")
def f25_steps_text(spark, d):
    p = part(spark, d)
    return p.select(
        "p_partkey",
        S.steps_text(
            F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array("p_name", "p_brand"))).otherwise(F.col("p_name"))
        ).alias("steps"),
    )


@query("SELECT event_id, ts - INTERVAL '5 hours 30 minutes' AS shown FROM events")
def f26_in_zone(spark, d):
    return events(spark, d).select("event_id", S.in_zone("ts", "Asia/Kolkata").alias("shown"))
