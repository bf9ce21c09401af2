"""Filters, series, searches and pickers P1-P13."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import select
from ..operators.textindex import TextIndex
from ..storage import shared_dir
from . import query


@query(fx.sql("SELECT * FROM stmt WHERE dbname = 'A' AND instance = 'F' AND begin_snap BETWEEN 10 AND 20", "stmt"))
def p1_snap_range_filter(spark, d):
    return select.snap_range_filter(fx.stmt(spark, d), "A", "F", 10, 20)


@query(fx.sql("SELECT snap_time, dbname, event AS metric, pct AS value FROM wait WHERE event IN ('click', 'error') AND pct > 10", "wait"))
def p2_metric_series(spark, d):
    return select.metric_series(fx.wait(spark, d), "event", ["click", "error"], "pct", 10, ["dbname"])


@query(
    fx.sql(
        "SELECT hostname, snap_time, object, value FROM host "
        "WHERE hostname IN (1, 3) AND day BETWEEN '2024-01-05' AND '2024-01-12' AND object <> 'view'",
        "host",
    )
)
def p3_host_series(spark, d):
    return select.host_series(
        fx.host(spark, d), [1, 3], "2024-01-05", "2024-01-12", without=["view"]
    ).select("hostname", "snap_time", "object", "value")


@query(
    fx.sql(
        "SELECT sql_id, begin_snap, md5(sql_text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY sql_id "
        "ORDER BY begin_snap DESC) AS n FROM txt WHERE sql_text ILIKE '%license%') WHERE n = 1 ORDER BY sql_id LIMIT 50",
        "txt",
    )
)
def p5_text_search(spark, d):
    found = select.newest_values(
        select.text_search(fx.text(spark, d), "sql_text", "LICENSE"), ["sql_id"], F.col("begin_snap"), ["begin_snap", "sql_text"]
    )
    return select.top_k(found, 50, F.col("sql_id")).select("sql_id", "begin_snap", F.md5("sql_text").alias("text_md5"))


def _index(spark, d, loads, columns):
    """Statement texts indexed in several loads, by snapshot."""
    index = TextIndex(spark, f"{shared_dir(spark)}/text-index-{uuid.uuid4().hex[:12]}", ["sql_id", "begin_snap"], columns, slots=16, parts=16)
    for k in range(loads):
        index.load(str(k), fx.text(spark, d).where(F.col("begin_snap") % loads == k))
    return index


@query(
    fx.sql(
        "SELECT sql_id, begin_snap, md5(sql_text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY sql_id "
        "ORDER BY begin_snap DESC) AS n FROM txt WHERE sql_text ILIKE '%under the apache%' OR sql_text ILIKE '%license%') WHERE n = 1",
        "txt",
    )
)
def p5_indexed_search(spark, d):
    """P5 by the trigram index: two queries against texts that came in two loads, the newest text of each statement."""
    index = _index(spark, d, 2, ["sql_text"])
    found = index.search("Under the Apache").union(index.search("LICENSE"))
    return select.newest_values(found, ["sql_id"], F.col("begin_snap"), ["begin_snap", "sql_text"]).select(
        "sql_id", "begin_snap", F.md5("sql_text").alias("text_md5")
    )


@query(
    fx.sql(
        "SELECT begin_snap, sql_id, dbname FROM txt WHERE dbname ILIKE '%src1%' OR sql_text ILIKE '%src1%' ORDER BY begin_snap DESC LIMIT 100",
        "txt",
    )
)
def p7_indexed_search(spark, d):
    """P7 by the trigram index: one query against several columns, the newest 100."""
    found = _index(spark, d, 1, ["dbname", "sql_text"]).search("SRC1")
    return select.top_k(found, 100, F.desc("begin_snap")).select("begin_snap", "sql_id", "dbname")


@query(
    fx.sql(
        "SELECT sql_id, begin_snap, dbname, md5(sql_text) AS text_md5 FROM txt WHERE sql_id = 42 ORDER BY begin_snap DESC LIMIT 1", "txt"
    )
)
def p6_id_search(spark, d):
    found = select.id_search(fx.text(spark, d), "sql_id", 42, "begin_snap", ["begin_snap", "dbname", "sql_text"])
    return found.select("sql_id", "begin_snap", "dbname", F.md5("sql_text").alias("text_md5"))


@query(
    fx.sql(
        "SELECT begin_snap, dbname, instance FROM txt WHERE dbname ILIKE '%c1%' OR instance ILIKE '%E%' ORDER BY begin_snap DESC "
        "LIMIT 100",
        "txt",
    )
)
def p7_plan_search(spark, d):
    t = fx.text(spark, d).where(F.col("dbname").ilike("%c1%") | F.col("instance").ilike("%E%"))
    return select.top_k(t, 100, F.desc("begin_snap")).select("begin_snap", "dbname", "instance")


@query(fx.sql("SELECT dbname, instance, count(*) AS n FROM wait WHERE event = 'click' GROUP BY ALL", "wait"))
def p8_optional_filter(spark, d):
    return select.optional_filter(fx.wait(spark, d), event="click", dbname="").groupBy("dbname", "instance").agg(F.count("*").alias("n"))


@query(fx.sql("SELECT '' AS choice UNION ALL SELECT DISTINCT begin_snap::VARCHAR FROM load", "load"))
def p9_picker_values(spark, d):
    return select.picker_values(fx.load(spark, d), "begin_snap")


@query(
    fx.sql(
        "SELECT sql_id, begin_snap, md5(regexp_replace(sql_text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')) AS text_md5 "
        "FROM (SELECT *, row_number() OVER (PARTITION BY sql_id ORDER BY begin_snap DESC) AS n FROM txt) WHERE n = 1",
        "txt",
    )
)
def p11_text_viewer(spark, d):
    newest = select.text_viewer(fx.text(spark, d), "sql_id", "sql_text", "begin_snap")
    return newest.select("sql_id", "begin_snap", F.md5("sql_text").alias("text_md5"))


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def p12_tag_list(spark, d):
    return select.tag_list(
        fx.table(spark, d, "orders"), "o_orderdate", "o_orderkey", o_orderstatus="F"
    ).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY l_linenumber")
def p12_plan_get(spark, d):
    return select.plan_get(
        fx.table(spark, d, "lineitem"), "l_orderkey", 7, "l_linenumber"
    ).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC, o_orderkey "
    "LIMIT 100"
)
def p12_feedback_history(spark, d):
    found = select.feedback_history(fx.table(spark, d, "orders"), "o_orderstatus", "o_orderdate", "o_orderkey", among=["O", "P"])
    return found.select("o_orderkey", "o_orderstatus", "o_orderdate")


@query(
    fx.sql(
        "SELECT total_wait_time_s AS size, pct AS est_time FROM wait WHERE dbname = 1 AND instance = 2 AND begin_snap = 9 "
        "ORDER BY size, est_time",
        "wait",
    )
)
def p13_advisory_curve(spark, d):
    w = fx.wait(spark, d).withColumnsRenamed({"total_wait_time_s": "size", "pct": "est_time"})
    return select.advisory_curve(w, 1, 2, 9, "size", ["est_time"])
