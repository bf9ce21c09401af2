"""Role views: the shapes that the operators read, taken from the test tables. ``SQL`` has the same views for DuckDB."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH, MONTHS = "2024-01-01", "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host samples: hostname, snap_time, day, object, value."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("hostname"),
        F.col("ts").alias("snap_time"),
        F.to_date("ts").alias("day"),
        F.col("event_type").alias("object"),
        "value",
    )


def wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait events: dbname, instance, begin_snap, snap_time, event, pct, waits, total_wait_time_s, avg_wait_ms."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 2).alias("dbname"),
        (F.col("user_id") % 3).alias("instance"),
        F.datediff("ts", F.lit(EPOCH)).alias("begin_snap"),
        F.col("ts").alias("snap_time"),
        F.col("event_type").alias("event"),
        (F.col("value") / 5).alias("pct"),
        F.lit(1).cast("long").alias("waits"),
        F.col("value").alias("total_wait_time_s"),
        F.col("value").alias("avg_wait_ms"),
    )


def _months(c: str) -> F.Column:
    return ((F.year(c) - 1995) * 12 + F.month(c) - 1).alias("begin_snap")


def stmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements: dbname, instance, begin_snap, snap_time, sql_id, elapsed, cpu, executions, parses."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("dbname"),
        F.col("l_linestatus").alias("instance"),
        _months("l_shipdate"),
        F.col("l_shipdate").alias("snap_time"),
        F.col("l_suppkey").alias("sql_id"),
        F.col("l_extendedprice").alias("elapsed"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cpu"),
        F.col("l_quantity").alias("executions"),
        F.col("l_linenumber").cast("long").alias("parses"),
    )


#: Segment metrics and the column that plays each; every metric sits on its own line numbers, so joins have gaps.
SEGMENT_METRICS = {
    "logical_reads": ("l_quantity", (1, 2, 3)),
    "physical_reads": ("l_extendedprice", (1, 2, 4)),
    "physical_writes": ("l_tax", (2, 3, 5)),
    "row_lock_waits": ("l_discount", (1, 5, 6)),
    "table_scans": ("l_quantity", (4, 6)),
}


def seg(spark: SparkSession, sf_dir: str, metrics: Sequence[str] = tuple(SEGMENT_METRICS)) -> DataFrame:
    """Segment metrics in long form: dbname, instance, begin_snap, owner, object_name, obj_type, metric, value. ``metrics``: the only ones wanted."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.when(F.col("l_linenumber").isin(*on), F.col(c)).alias("value"))
            for m, (c, on) in SEGMENT_METRICS.items()
            if m in metrics
        ]
    )
    j = li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.col("l_returnflag").alias("dbname"),
        F.col("l_linestatus").alias("instance"),
        _months("l_shipdate"),
        F.col("p_brand").alias("owner"),
        F.col("p_partkey").alias("object_name"),
        F.split_part("p_type", F.lit(" "), F.lit(1)).alias("obj_type"),
        F.explode(rows).alias("m"),
    )
    return j.where("m.value is not null").select(
        "dbname", "instance", "begin_snap", "owner", "object_name", "obj_type", "m.metric", "m.value"
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object metadata; ``analysed_days`` before "now"."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_brand").alias("owner"),
        F.col("p_partkey").alias("object_name"),
        F.when(F.col("p_partkey") % 3 == 0, "INDEX").otherwise("TABLE").alias("object_type"),
        (F.col("p_partkey") * 1e5).alias("num_rows"),
        (F.col("p_size") % 7).alias("blevel"),
        (F.col("p_retailprice") * 1e5).alias("clustering_factor"),
        F.when(F.col("p_size") % 2 == 1, "RANGE").alias("partition_type"),
        F.when(F.col("p_size") % 3 == 0, "BASIC").alias("compression"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 3).alias("analysed_days"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load profile: dbname, instance, begin_snap, snap_time, metric, per_sec."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("dbname"),
        F.col("o_orderpriority").alias("instance"),
        _months("o_orderdate"),
        F.col("o_orderdate").alias("snap_time"),
        F.col("o_orderpriority").alias("metric"),
        F.col("o_totalprice").alias("per_sec"),
    )


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement texts: sql_id, sql_text, dbname, instance, begin_snap."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % 400).alias("sql_id"),
        F.col("text").alias("sql_text"),
        F.col("source").alias("dbname"),
        F.col("lang").alias("instance"),
        F.col("doc_id").alias("begin_snap"),
    )


def sqltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL statements over the parts: sql_id, sql_text (written by Spark from part and lineitem columns)."""
    p = table(spark, sf_dir, "part")
    name, brand = F.concat(F.lit("t"), (F.col("p_partkey") % 97).cast("string")), F.lower(F.regexp_replace("p_brand", "#", "_"))
    s = F.when(
        F.col("p_partkey") % 4 == 0,
        F.concat(
            F.lit("SELECT /* hint "),
            F.col("p_type"),
            F.lit(" */ 'from x.y' FROM "),
            brand,
            F.lit("."),
            name,
            F.lit(" a JOIN "),
            name,
            F.lit("_dim b ON a.k = b.k"),
        ),
    )
    s = s.when(
        F.col("p_partkey") % 4 == 1,
        F.concat(F.lit("UPDATE "), brand, F.lit("."), name, F.lit(" SET c = 'it -- x' -- tail from z\n WHERE k = 1")),
    )
    s = s.when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("INSERT  INTO "), name, F.lit("\nSELECT * FROM "), brand, F.lit("."), name))
    s = s.otherwise(F.concat(F.lit("delete from "), name, F.lit(" where c in (select k from  "), brand, F.lit(".keys)")))
    return p.select(F.col("p_partkey").alias("sql_id"), s.alias("sql_text"))


#: DuckDB definitions of the same views.
SQL = {
    "host": "SELECT user_id % 5 AS hostname, ts AS snap_time, ts::DATE AS day, event_type AS object, value FROM events",
    "wait": "SELECT user_id % 2 AS dbname, user_id % 3 AS instance, datediff('day', DATE '2024-01-01', "
    "ts::DATE)::INT AS begin_snap, ts AS snap_time, event_type AS event, value / 5 AS pct, 1::BIGINT AS "
    "waits, value AS total_wait_time_s, value AS avg_wait_ms FROM events",
    "stmt": "SELECT l_returnflag AS dbname, l_linestatus AS instance, ((year(l_shipdate) - 1995) * 12 + "
    "month(l_shipdate) - 1)::INT AS begin_snap, l_shipdate AS snap_time, l_suppkey AS sql_id, "
    "l_extendedprice AS elapsed, l_extendedprice * (1 - l_discount) AS cpu, l_quantity AS executions, "
    "l_linenumber::BIGINT AS parses FROM lineitem",
    "seg": "SELECT l_returnflag AS dbname, l_linestatus AS instance, ((year(l_shipdate) - 1995) * 12 + "
    "month(l_shipdate) - 1)::INT AS begin_snap, p_brand AS owner, p_partkey AS object_name, "
    "split_part(p_type, ' ', 1) AS obj_type, m.metric AS metric, m.value AS value FROM lineitem "
    "JOIN part ON l_partkey = p_partkey, LATERAL (SELECT unnest(["
    + ", ".join(f"{{'metric': '{m}', 'value': CASE WHEN l_linenumber IN {on} THEN {c} END}}" for m, (c, on) in SEGMENT_METRICS.items())
    + "]) AS m) WHERE m.value IS NOT NULL",
    "meta": "SELECT p_brand AS owner, p_partkey AS object_name, CASE "
    "WHEN p_partkey % 3 = 0 THEN 'INDEX' ELSE 'TABLE' END AS object_type, p_partkey * 1e5 AS num_rows, "
    "p_size % 7 AS blevel, p_retailprice * 1e5 AS clustering_factor, CASE "
    "WHEN p_size % 2 = 1 THEN 'RANGE' END AS partition_type, CASE " "WHEN p_size % 3 = 0 THEN 'BASIC' END AS compression, CASE "
    "WHEN p_size % 10 <> 0 THEN p_size * 3 END AS analysed_days FROM part",
    "load": "SELECT o_orderstatus AS dbname, o_orderpriority AS instance, ((year(o_orderdate) - 1995) * 12 + "
    "month(o_orderdate) - 1)::INT AS begin_snap, o_orderdate AS snap_time, o_orderpriority AS metric, "
    "o_totalprice AS per_sec FROM orders",
    "txt": "SELECT doc_id % 400 AS sql_id, text AS sql_text, source AS dbname, lang AS instance, doc_id AS begin_snap FROM documents",
    "sqltext": "SELECT p_partkey AS sql_id, CASE p_partkey % 4 "
    "WHEN 0 THEN 'SELECT /* hint ' || p_type || ' */ ''from x.y'' FROM ' || b || '.' || n || ' a "
    "JOIN ' || n || '_dim b ON a.k = b.k' WHEN 1 THEN 'UPDATE ' || b || '.' || n || ' SET c = ''it -- x'' "
    "-- tail from z' || chr(10) || ' WHERE k = 1' WHEN 2 THEN 'INSERT  INTO ' || n || chr(10) || 'SELECT * "
    "FROM ' || b || '.' || n ELSE 'delete from ' || n || ' where c in (select k from  ' || b || '.keys)' "
    "END AS sql_text FROM (SELECT *, lower(replace(p_brand, '#', '_')) AS b, 't' || (p_partkey % 97) AS n " "FROM part)",
}


def sql(body: str, *views: str, ctes: str = "") -> str:
    """DuckDB text with the named role views in front."""
    heads = [f"{v} AS ({SQL[v]})" for v in views] + ([ctes.strip().rstrip(",")] if ctes else [])
    return (f"WITH {', '.join(heads)} " if heads else "") + body
