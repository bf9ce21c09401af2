"""Sources SRC1-SRC13 on texts that Spark writes from the test tables; the SQL side reads the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import fixture_texts as ft
from .. import fixtures as fx
from ..operators.select import header_carry, socket_ratios
from ..plans import listings, panels
from ..sources import delimited, hostlog, plan_text, report
from ..storage import shared_dir
from . import ORACLE, query

E = (
    "(SELECT *, 'host' || (user_id % 5) AS hostname, date_trunc('second', ts) AS snap_time, user_id % 2 = 1 AND user_id % 5 % 2 = 1 AS "
    "x, (user_id % 5) % 2 = 1 AS odd, event_id % 6 AS k FROM events) e"
)


def _rows(spark, d, shift=None):
    return hostlog.log_lines(ft.host_logs(spark, d), shift)


@query(
    "SELECT hostname, snap_time, CASE event_type WHEN 'click' THEN 'CPU' WHEN 'view' THEN CASE "
    "WHEN odd THEN 'kbmemfree' ELSE 'kbavail' END WHEN 'error' THEN 'DEV' "
    "WHEN 'purchase' THEN 'kbswpfree' ELSE ['IFACE', 'pgpgin/s', 'proc/s', 'runq-sz', 'kbhugfree', 'totsck'][k + 1] END AS section, "
    f"count(*) AS n FROM {E} GROUP BY ALL"
)
def src4_hostlog_lines(spark, d):
    return _rows(spark, d).groupBy("hostname", "snap_time", "section").agg(F.count("*").alias("n"))


FLAWED = (
    "(SELECT event_id, value, 'host' || h || '-' || CAST(ts AS DATE) AS path, CASE WHEN h = 3 THEN 'UNKNOWN_HOST' ELSE 'host' || h END AS hostname, "
    "date_trunc('second', ts) AS snap_time, user_id, k, CASE WHEN h = 3 THEN 'no date' WHEN k = 2 THEN 'bad time' WHEN k IN (3, 5) THEN 'no header' "
    "WHEN k = 1 THEN 'few cells' END AS reason FROM (SELECT *, user_id % 5 AS h, event_id % 8 AS k FROM events)) f"
)


@query(
    f"SELECT path, hostname, reason, count(*) AS n FROM {FLAWED} WHERE reason IS NOT NULL GROUP BY ALL UNION ALL "
    "SELECT 'host' || (user_id % 5) || '-' || CAST(ts AS DATE), CASE WHEN user_id % 5 = 3 THEN 'UNKNOWN_HOST' ELSE 'host' || (user_id % 5) END, "
    # noise is told from a banner by its place: what stands in the first ten lines is passed over
    "'unreadable', count(*) FILTER (WHERE line > 10) FROM (SELECT *, CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 9 END "
    "+ sum(CASE event_id % 8 WHEN 3 THEN 3 WHEN 5 THEN 5 WHEN 6 THEN 5 ELSE 4 END) OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY event_id) "
    "- 2 AS line FROM events) WHERE event_id % 8 = 5 GROUP BY ALL HAVING count(*) FILTER (WHERE line > 10) > 0"
)
def src4_hostlog_rejects(spark, d):
    return hostlog.rejected_lines(ft.flawed_logs(spark, d)).groupBy("path", "hostname", "reason").agg(F.count("*").alias("n"))


@query(
    "SELECT path, hostname, snap_time, CASE WHEN k = 4 THEN user_id ELSE event_id END::DOUBLE AS usr_pct, value AS idle_pct "
    f"FROM {FLAWED} WHERE reason IS NULL"
)
def src5_hostlog_cpu_flawed(spark, d):
    """What is left of logs with torn rows, bad clocks, lost and repeated headers, noise and banners."""
    rows = hostlog.log_lines(ft.flawed_logs(spark, d)).where("section = 'CPU'")
    return rows.select("path", "hostname", "snap_time", hostlog.field("%user").alias("usr_pct"), hostlog.field("%idle").alias("idle_pct"))


@query(
    "SELECT hostname, snap_time, 'all' AS cpu, value AS usr_pct, 0.0::DOUBLE AS nice_pct, user_id::DOUBLE AS system_pct, "
    f"event_id::DOUBLE AS iowait_pct, 0.0::DOUBLE AS steal_pct, value AS idle_pct FROM {E} WHERE event_type = 'click'"
)
def src5_hostlog_cpu(spark, d):
    return hostlog.cpu(_rows(spark, d))


@query(
    "SELECT hostname, snap_time, round(event_id / 1024, 3) AS mem_free_mb, round(user_id / 1024, 3) AS mem_used_mb, value AS "
    "mem_used_pct, 2.0::DOUBLE AS buffers_mb, round(event_id / 1024, 3) AS cached_mb, 0.0::DOUBLE AS commit_mb, 0.0::DOUBLE AS "
    f"commit_pct FROM {E} WHERE event_type = 'view'"
)
def src6_hostlog_memory(spark, d):
    return hostlog.memory(_rows(spark, d))


@query(
    "SELECT hostname, snap_time, round(event_id / 1024, 3) AS swap_free_mb, round(user_id / 1024, 3) AS swap_used_mb, round(CASE "
    f"WHEN odd THEN coalesce(user_id / nullif(event_id + user_id, 0) * 100, 0) ELSE value END, 9) AS swap_used_pct FROM {E} "
    "WHERE event_type = 'purchase'"
)
def src7_hostlog_swap(spark, d):
    return hostlog.swap(_rows(spark, d)).withColumn("swap_used_pct", F.round("swap_used_pct", 9))


@query(
    "SELECT hostname, snap_time, 'sda' AS device, value AS tps, round(event_id / CASE "
    "WHEN odd THEN 2048 ELSE 1024 END, 4) AS read_mb_per_sec, round(user_id / CASE "
    "WHEN odd THEN 2048 ELSE 1024 END, 4) AS write_mb_per_sec, value AS await_ms, CASE "
    f"WHEN odd THEN 0.0::DOUBLE END AS svctm_ms, value AS util_pct FROM {E} WHERE event_type = 'error'"
)
def src8_hostlog_disk(spark, d):
    return hostlog.disk(_rows(spark, d))


_PLAIN_SQL = {
    "network": (
        0,
        "'eth0' AS iface, value AS rxpck_per_sec, event_id::DOUBLE AS txpck_per_sec, user_id::DOUBLE AS rxkb_per_sec, value AS "
        "txkb_per_sec, 0.0::DOUBLE AS rxcmp_per_sec, 0.0::DOUBLE AS txcmp_per_sec, 0.0::DOUBLE AS rxmcst_per_sec, 0.0::DOUBLE AS "
        "ifutil_pct",
    ),
    "paging": (
        1,
        "value AS pgpgin_per_sec, event_id::DOUBLE AS pgpgout_per_sec, user_id::DOUBLE AS fault_per_sec, value AS majflt_per_sec, "
        "0.0::DOUBLE AS pgfree_per_sec, 0.0::DOUBLE AS pgscank_per_sec, 0.0::DOUBLE AS pgscand_per_sec, 0.0::DOUBLE AS pgsteal_per_sec, "
        "0.0::DOUBLE AS vmeff_pct",
    ),
    "ctxswitch": (2, "value AS proc_per_sec, event_id::DOUBLE AS cswch_per_sec"),
    "loadavg": (
        3,
        "event_id::DOUBLE AS runq_sz, user_id::DOUBLE AS plist_sz, value AS ldavg_1, value AS ldavg_5, value AS ldavg_15, 0.0::DOUBLE "
        "AS blocked",
    ),
    "hugepage": (
        4,
        "event_id::DOUBLE AS kbhugfree, user_id::DOUBLE AS kbhugused, value AS hugused_pct, 0.0::DOUBLE AS kbhugrsvd, 0.0::DOUBLE AS "
        "kbhugsurp",
    ),
    "socket": (
        5,
        "event_id::DOUBLE AS totsck, user_id::DOUBLE AS tcpsck, value AS udpsck, 0.0::DOUBLE AS rawsck, 0.0::DOUBLE AS ip_frag, "
        "0.0::DOUBLE AS tcp_tw",
    ),
}


def _plain(kind):
    def run(spark, d):
        return hostlog.plain(_rows(spark, d), kind)

    run.__name__ = f"src9_hostlog_{kind}"
    k, columns = _PLAIN_SQL[kind]
    return query(
        f"SELECT hostname, snap_time, {columns} FROM {E} WHERE event_type NOT IN ('click', 'view', 'error', 'purchase') AND k = {k}"
    )(run)


for _kind in _PLAIN_SQL:
    _plain(_kind)


@query(
    "SELECT hostname, snap_time, event_id::DOUBLE AS totsck, event_id - user_id - value AS other_sockets, CASE "
    f"WHEN user_id <> 0 THEN 0.0::DOUBLE END AS tw_pct FROM {E} WHERE event_type NOT IN ('click', 'view', 'error', 'purchase') AND k = 5"
)
def p4_derived_ratios(spark, d):
    return socket_ratios(hostlog.plain(_rows(spark, d), "socket")).select("hostname", "snap_time", "totsck", "other_sockets", "tw_pct")


@query(f"SELECT hostname, snap_time + INTERVAL '5 hours 30 minutes' AS snap_time, value AS usr_pct FROM {E} WHERE event_type = 'click'")
def src10_hostlog_tz_shift(spark, d):
    return hostlog.cpu(_rows(spark, d, "5 hours 30 minutes")).select("hostname", "snap_time", "usr_pct")


# --- host panels ---------------------------------------------------------------------------------------------------------


def _panel(name, table, at, entity, tail="", status="NULL", **measures):
    """A panel's own SQL; ``tail`` follows FROM."""
    pairs = ", ".join(f"{{'m': '{m.strip('_')}', 'v': ({v})::DOUBLE}}" for m, v in measures.items())
    return (
        f"SELECT hostname, '{name}' AS panel, \"at\", entity, u.m AS measure, round(u.v, 6) AS value, status FROM (SELECT hostname, {at} AS \"at\", "
        f"{entity} AS entity, {status}::VARCHAR AS status, unnest([{pairs}]) AS u FROM {table} {tail})"
    )


def _by_device(name, column):
    lead = f"SELECT hostname, device FROM disk GROUP BY hostname, device QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY avg({column}) DESC, device) <= 5"
    return _panel(name, "disk", "snap_time", "device", f"WHERE (hostname, device) IN ({lead})", **{column: column})


_T, _N = "snap_time", "NULL::TIMESTAMP"
_PER_HOST = "GROUP BY hostname"
PANEL_SQL = [
    _panel("cpu_shares", "cpu", _T, "NULL", user="usr_pct", system="system_pct", iowait="iowait_pct", idle="idle_pct"),
    _panel("cpu_iowait", "cpu", _N, "NULL", _PER_HOST, iowait="avg(iowait_pct)"),
    _panel("cpu_idle", "cpu", _N, "NULL", _PER_HOST, idle="avg(idle_pct)"),
    _panel("memory_mb", "memory", _T, "NULL", used="mem_used_mb", free="mem_free_mb", cached="cached_mb", buffers="buffers_mb"),
    _panel("memory_shares", "memory", _T, "NULL", used="mem_used_pct", commit="commit_pct"),
    _panel("swap_used_mb", "swap", _T, "NULL", used="swap_used_mb"),
    _panel("swap_used_share", "swap", _N, "NULL", _PER_HOST, used="avg(swap_used_pct)"),
    _panel("swap_free_mb", "swap", _T, "NULL", free="swap_free_mb"),
    _panel("disk_throughput", "disk", _T, "NULL", "GROUP BY hostname, snap_time", read="sum(read_mb_per_sec)", write="sum(write_mb_per_sec)"),
    _panel("disk_util_max", "disk", _T, "NULL", "GROUP BY hostname, snap_time", util="max(util_pct)"),
    _panel("network_rates", "network", _T, "iface", received="rxkb_per_sec", sent="txkb_per_sec"),
    _panel("network_util", "network", _T, "iface", util="ifutil_pct"),
    _panel("run_queue", "loadavg", _T, "NULL", queue="runq_sz", blocked="blocked"),
    _panel("load_average", "loadavg", _T, "NULL", _1="ldavg_1", _5="ldavg_5", _15="ldavg_15"),
    _panel("context_switches", "ctxswitch", _T, "NULL", switches="cswch_per_sec"),
    _panel("page_faults", "paging", _T, "NULL", minor="fault_per_sec", major="majflt_per_sec"),
    _panel("vm_efficiency", "paging", _N, "NULL", _PER_HOST, efficiency="avg(vmeff_pct)"),
    _by_device("device_read", "read_mb_per_sec"),
    _by_device("device_write", "write_mb_per_sec"),
    _by_device("device_await", "await_ms"),
    _by_device("device_util", "util_pct"),
    _by_device("device_tps", "tps"),
    _panel(
        "device_summary", "disk", _N, "device", "GROUP BY hostname, device",
        "CASE WHEN avg(util_pct) >= 85 THEN 'saturated' WHEN avg(util_pct) >= 60 THEN 'high' WHEN avg(await_ms) >= 50 THEN 'slow' ELSE 'ok' END",
        tps="avg(tps)", read="avg(read_mb_per_sec)", write="avg(write_mb_per_sec)", service="avg(svctm_ms)", util="avg(util_pct)",
        peak_util="max(util_pct)", peak_await="max(await_ms)", await_="avg(await_ms)",
    ),
    _panel("hugepages_used_share", "hugepage", _N, "NULL", _PER_HOST, used="avg(hugused_pct)"),
    _panel("hugepages_free_mb", "hugepage", _N, "NULL", _PER_HOST, free="avg(kbhugfree) / 1024"),
    _panel("hugepages_used_gb", "hugepage", _N, "NULL", _PER_HOST, used="avg(kbhugused) / 1024 / 1024"),
    _panel(
        "hugepages_now", "(SELECT * FROM hugepage QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY snap_time DESC) = 1)", _T, "NULL",
        free_kb="kbhugfree", used_mb="kbhugused / 1024",
    ),
    _panel("hugepages_trend", "hugepage", _T, "NULL", used_mb="kbhugused / 1024", free_mb="kbhugfree / 1024"),
    _panel("hugepages_share", "hugepage", _T, "NULL", used="hugused_pct"),
    _panel("sockets", "socket", _T, "NULL", total="totsck", tcp="tcpsck", udp="udpsck"),
    _panel("time_wait", "socket", _T, "NULL", time_wait="tcp_tw"),
    _panel(
        "connection_health", "socket", _T, "NULL", total="totsck", time_wait="tcp_tw", other="totsck - tcpsck - udpsck",
        time_wait_share="tcp_tw / nullif(tcpsck, 0) * 100",
    ),
]
_LOG_TABLES = ["cpu", "memory", "swap", "disk", *_PLAIN_SQL]
_LOG_SQL = {
    t: ORACLE[next(n for n in ORACLE if n in (f"src{i}_hostlog_{t}" for i in range(5, 10)))] for t in _LOG_TABLES
}
_PANEL_RANGE = "2024-01-03", "2024-01-20"


@query(
    "WITH "
    + ", ".join(
        f"{t} AS (SELECT * FROM ({q}) x WHERE snap_time::DATE BETWEEN '{_PANEL_RANGE[0]}' AND '{_PANEL_RANGE[1]}')" for t, q in _LOG_SQL.items()
    )
    + " "
    + " UNION ALL ".join(PANEL_SQL)
)
def x11_host_panels(spark, d):
    """The named panels of all hosts from their logs; the logs are parsed once."""
    path = f"{shared_dir(spark)}/panels-{uuid.uuid4().hex[:12]}"
    _rows(spark, d).write.parquet(path)
    rows = spark.read.parquet(path)
    tables = {t: getattr(hostlog, t)(rows) for t in ("cpu", "memory", "swap", "disk")} | {t: hostlog.plain(rows, t) for t in hostlog.PLAIN}
    return panels.host_panels(tables, *_PANEL_RANGE).withColumn("value", F.round("value", 6))


# --- reports, listings and delimited files --------------------------------------------------------------------------

R = (
    "(SELECT 'DB' || dbname AS db, 'DB' || dbname || instance AS inst, instance AS no, begin_snap, event, sum(waits)::BIGINT AS waits, "
    "sum(total_wait_time_s) AS t, round(avg(pct), 2) AS pct, min(snap_time) AS first FROM wait GROUP BY ALL)"
)


def _files(spark, d, df, kind):
    """Writes texts as files of the shared folder and reads them back through the source."""
    path = f"{shared_dir(spark)}/texts-{kind}-{uuid.uuid4().hex[:12]}"
    df.write.text(path)
    return path


@query(
    fx.sql(
        "SELECT db AS dbname, inst AS instance, no::INT AS instnum, begin_snap, event, waits::DOUBLE AS waits, round(t, 2) AS "
        f"total_wait_time_s FROM {R}",
        "wait",
    )
)
def src1_report_sections(spark, d):
    f = report.facts(ft.reports(spark, d), "foreground_wait_events")
    return f.select("dbname", "instance", "instnum", "begin_snap", "event", "waits", "total_wait_time_s")


@query(
    fx.sql(
        f"SELECT db AS dbname, inst AS instance, no::INT AS instnum, begin_snap, date_trunc('second', min(first)) AS snap_time FROM {R} "
        "GROUP BY ALL",
        "wait",
    )
)
def src2_report_metadata(spark, d):
    return report.metadata(report.report_rows(ft.reports(spark, d))).drop("path")


@query(
    "SELECT event_id, CASE event_id % 6 WHEN 1 THEN date_trunc('minute', ts) WHEN 5 THEN NULL ELSE date_trunc('second', ts) END AS snap_time, CASE "
    "WHEN event_id % 6 = 5 THEN 'bad snap time' END AS reason FROM events"
)
def src2_report_times(spark, d):
    """Reports whose snapshot times come in six formats, the last of them unreadable."""
    # A small table lies in one task: its rows are dealt before they become reports, since parsing takes the time.
    e = fx.table(spark, d, "events").select("event_id", "ts").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")
    formats = ["dd-MMM-yy HH:mm:ss", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy hh:mm:ss a", "d MMMM yyyy HH:mm:ss", "'garbage' dd"]
    time = F.element_at(F.array(*[F.date_format("ts", f) for f in formats]), (F.col("event_id") % 6 + 1).cast("int"))
    info = '<table summary="This table displays database instance information"><tr><th>DB Name</th><th>Instance</th></tr><tr><td>D</td><td>I</td></tr></table>'
    snaps = '<table summary="This table displays snapshot information"><tr><th></th><th>Snap Id</th><th>Snap Time</th></tr><tr><td>Begin Snap:</td><td>7</td><td>'
    files = e.select(F.col("event_id").cast("string").alias("path"), F.concat(F.lit(info + snaps), time, F.lit("</td></tr></table>")).alias("content"))
    return report.checked_metadata(files).select(F.col("path").cast("long").alias("event_id"), "snap_time", "reason")


@query(
    fx.sql(
        "SELECT DISTINCT db AS dbname, db AS folder, inst AS instance, no::INT AS instnum, CASE "
        "WHEN no % 2 = 0 THEN '11.2' ELSE '19.0' END AS release, begin_snap % 2 = 0 AS rac, no % 2 = 1 AS cdb, CASE "
        f"WHEN no % 2 = 1 THEN 'PDB$' || begin_snap END AS pdb, begin_snap FROM {R}",
        "wait",
    )
)
def src3_report_header_probe(spark, d):
    return report.header_probe(ft.reports(spark, d)).withColumn(
        "begin_snap", F.regexp_extract("path", r"_(\d+)\.html", 1).cast("int")
    ).drop("path")


LI = (
    "(SELECT l_orderkey, l_linenumber, min({'p': l_partkey, 'q': l_quantity, 'e': l_extendedprice, 'op': (['TABLE ACCESS FULL', 'INDEX "
    "RANGE SCAN', 'NESTED LOOPS', 'INDEX FAST FULL SCAN', 'HASH "
    "JOIN', 'FIXED TABLE FULL', 'PARTITIONED TABLE ACCESS FULL'])[(l_partkey % 7 + 1)::INT]}) AS m FROM lineitem GROUP BY ALL)"
)
STEP_SQL = f"""st AS (SELECT (l_orderkey // 2)::VARCHAR AS path, 'q' || l_orderkey AS sql_id, l_linenumber::INT AS step_id, m.op AS
  operation, 'T' || (m.p % 50) AS object_name, CASE WHEN m.e >= 50000 THEN floor(m.e / 1000) * 1000 ELSE floor(m.e) END AS rows,
  floor(m.q) AS bytes, floor(m.e / 5) AS cost,
 CASE WHEN l_linenumber % 2 = 0 THEN 'filter("A"=' || m.p || ' AND B>1)' END AS predicate FROM {LI} UNION ALL
  SELECT (o // 2)::VARCHAR, 'q' || o, 0, 'SELECT STATEMENT', NULL, NULL, NULL, 12, NULL
  FROM (SELECT DISTINCT l_orderkey AS o FROM lineitem))"""


@query(f"WITH {STEP_SQL} SELECT path, sql_id, step_id, operation, object_name, rows, bytes, cost, predicate FROM st")
def src11_plan_text(spark, d):
    return plan_text.plan_steps(ft.plan_texts(spark, d)).select(
        "path", "sql_id", "step_id", "operation", "object_name", "rows", "bytes", "cost", "predicate"
    )


@query(
    "SELECT 'orders' AS section, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders UNION ALL "
    "SELECT 'part', count(*), round(sum(p_retailprice), 2) FROM part"
)
def src12_sectioned_csv(spark, d):
    o = fx.table(spark, d, "orders").select(
        F.lit(" Orders").alias("Section"), F.col("o_orderkey").alias("Key No."), F.col("o_totalprice").alias("Amount (%)")
    )
    p = fx.table(spark, d, "part").select(F.lit("part"), "p_partkey", "p_retailprice")
    other = fx.table(spark, d, "region").select(F.lit("unmapped"), "r_regionkey", F.lit(0.0))
    lines = o.union(p).union(other).toDF(*o.columns)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    lines.write.csv(path, header=True)
    tables = delimited.sectioned_csv(
        spark, path, {"orders": ["id", "amount"], "part": ["id", "amount"]}, {"key_no": "id", "amount_pct": "amount"}
    )
    one = lambda s: tables[s].agg(
        F.lit(s).alias("section"), F.count("id").alias("n"), F.round(F.sum(F.col("amount").cast("double")), 2).alias("total")
    )
    return one("orders").union(one("part"))


@query(
    "SELECT p_partkey::VARCHAR AS id, p_retailprice AS amount, 'row' AS kind FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 10 <> 0 UNION ALL "
    "SELECT p_partkey::VARCHAR, NULL, 'reject' FROM part WHERE p_partkey % 3 < 2 AND p_partkey % 10 = 0"
)
def src12_sectioned_csv_headers(spark, d):
    """Files with columns in another order, each read by its own header; torn lines set aside."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    ft.flawed_csv(spark, d).repartition(3, "file").write.partitionBy("file").text(path)
    got = delimited.sectioned_csv(spark, path, {"part": ["id", "amount"]}, {"key_no": "id", "amount_pct": "amount"})["part"]
    lost = delimited.csv_rejects(spark, path).select(
        F.coalesce(F.nullif(F.regexp_extract("line", r"^part,(\d+)$", 1), F.lit("")), F.regexp_extract("line", r",Part,(\d+),more$", 1)).alias("id"),
        F.lit(None).cast("double").alias("amount"), F.lit("reject").alias("kind")
    )
    return got.select("id", F.col("amount").cast("double").alias("amount"), F.lit("row").alias("kind")).union(lost)


@query(
    "SELECT p_brand AS owner, p_partkey AS object_name, CASE WHEN p_size % 2 = 1 THEN p_size END::DOUBLE AS blevel, CASE "
    "WHEN p_partkey % 3 = 0 THEN p_name END AS first_column FROM part"
)
def src13_metadata_csv(spark, d):
    index = F.when(
        F.col("p_partkey") % 3 == 0, F.concat(F.lit('[{"col":"'), F.col("p_name"), F.lit('","pos":1,"desc":"ASC"}]'))
    ).otherwise("")
    p = fx.table(spark, d, "part").select(
        F.concat_ws(
            "|",
            F.concat(F.lit(" "), "p_brand"),
            F.col("p_partkey").cast("string"),
            F.when(F.col("p_size") % 2 == 1, F.col("p_size").cast("string")).otherwise("  "),
            index,
        ).alias("value")
    )
    path = _files(spark, d, p, "meta")
    m = delimited.metadata_csv(spark, path, "owner string, object_name bigint, blevel double, index_columns string", header=False)
    return m.select("owner", "object_name", "blevel", F.col("index_columns")[0]["col"].alias("first_column"))


PROBLEM_SQL = """pb AS (SELECT *, operation || ' on ' || coalesce(object_name, '?') AS message FROM (SELECT *, unnest(list_filter([CASE
  WHEN operation SIMILAR TO '.*(TABLE ACCESS|FIXED TABLE) FULL.*' THEN 'full scan' END, CASE
  WHEN operation LIKE '%INDEX FAST FULL SCAN%' AND rows > 10000 THEN 'large fast full scan' END,
 CASE WHEN operation LIKE '%NESTED LOOPS%' AND rows > 1000 THEN 'large nested loop' END, CASE WHEN cost > 10000 THEN 'high cost' END,
  CASE WHEN operation SIMILAR TO '.*(TABLE ACCESS|FIXED TABLE) FULL.*' AND predicate IS NULL THEN 'unbounded full scan' END], lambda x: x
  IS NOT NULL)) AS pattern FROM st)),
pr AS (SELECT path, sql_id, pattern, message, min(step_id) AS step_id FROM pb GROUP BY ALL)"""


@query(f"WITH {STEP_SQL}, {PROBLEM_SQL} SELECT path, sql_id, pattern, message, step_id FROM pr")
def x13_plan_problems(spark, d):
    columns = ("sql_id", "step_id", "operation", "object_name", "rows", "cost", "predicate")
    steps = plan_text.plan_steps(ft.plan_texts(spark, d), columns=columns, dealt=False)  # what is dealt are the problems
    return listings.plan_problems(steps, ["path", "sql_id"]).select("path", "sql_id", "pattern", "message", "step_id")


_AFTER = STEP_SQL.replace("st AS", "s2 AS").replace(
    "l_partkey % 7 + 1", "(l_partkey + CASE WHEN l_linenumber = 4 THEN 1 ELSE 0 END) % 7 + 1"
).replace("FROM lineitem GROUP BY ALL", "FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL").replace(
    "l_orderkey AS o FROM lineitem", "l_orderkey AS o FROM lineitem WHERE l_linenumber <> 3"
)
COMPARE_SQL = """n1 AS (SELECT *, upper(operation) AS op, coalesce(upper(object_name), '') AS ob, row_number() OVER (PARTITION BY path,
  sql_id, upper(operation), coalesce(upper(object_name), '') ORDER BY step_id) AS n FROM st),
n2 AS (SELECT *, upper(operation) AS op, coalesce(upper(object_name), '') AS ob, row_number() OVER (PARTITION BY path, sql_id,
  upper(operation), coalesce(upper(object_name), '') ORDER BY step_id) AS n FROM s2),
b AS (SELECT coalesce(x.path, y.path) AS path, coalesce(x.sql_id, y.sql_id) AS sql_id, x.step_id AS sb, y.step_id AS sa, x.cost AS cb,
  y.cost AS ca, x.operation AS ob, y.operation AS oa, x.object_name AS nb, y.object_name AS na FROM n1 x
  FULL JOIN n2 y ON x.path = y.path AND x.sql_id = y.sql_id AND x.op = y.op AND x.ob = y.ob AND x.n = y.n),
l AS (SELECT *, row_number() OVER (PARTITION BY path, sql_id ORDER BY sb) AS n FROM b
  WHERE sa IS NULL), r AS (SELECT *, row_number() OVER (PARTITION BY path, sql_id ORDER BY sa) AS n FROM b WHERE sb IS NULL),
m AS (SELECT path, sql_id, sb, sa, cb, ca, ob, oa, nb, na, false AS moved, CASE WHEN cb IS DISTINCT
  FROM ca THEN 'changed' ELSE 'same' END AS status FROM b WHERE sb IS NOT NULL AND sa IS NOT NULL
 UNION ALL SELECT coalesce(l.path, r.path), coalesce(l.sql_id, r.sql_id), l.sb, r.sa, l.cb, r.ca, l.ob, r.oa, l.nb, r.na, l.sb IS NOT
  NULL AND r.sa IS NOT NULL, CASE WHEN r.sa IS NULL THEN 'removed' WHEN l.sb IS NULL THEN 'added' ELSE 'changed' END FROM l
  FULL JOIN r ON l.path = r.path AND l.sql_id = r.sql_id AND l.n = r.n)"""


@query(
    f"WITH {STEP_SQL}, {_AFTER}, {COMPARE_SQL} SELECT path, sql_id, status, count(*) AS steps, round(sum(ca - cb), 2) AS cost_delta "
    "FROM m GROUP BY ALL"
)
def x14_plan_compare(spark, d):
    out = listings.plan_compare(*_both(spark, d), ["path", "sql_id"])
    return out.groupBy("path", "sql_id", "status").agg(F.count("*").alias("steps"), F.round(F.sum("cost_delta"), 2).alias("cost_delta"))


_FULL = "bool_or(operation SIMILAR TO '.*(TABLE ACCESS FULL|FIXED TABLE FULL|INDEX FAST FULL SCAN).*')"
VERDICT_SQL = f"""v AS (SELECT *, tot_a - tot_b AS cost_change, CASE
  WHEN tot_b > 0 THEN (tot_a - tot_b) / tot_b * 100 END AS cost_pct_change, tot_a < tot_b AS improved,
 CASE WHEN fb AND NOT fa THEN 'removed' WHEN NOT fb AND fa THEN 'introduced' END AS full_scans
 FROM (SELECT path, sql_id, arg_min(cost, step_id) AS tot_b, {_FULL} AS fb FROM st GROUP BY ALL)
  JOIN (SELECT path, sql_id, arg_min(cost, step_id) AS tot_a, {_FULL} AS fa FROM s2 GROUP BY ALL) USING (path, sql_id))"""


def _both(spark, d, lists=True):
    """Steps before and after, as a list a plan or a row a step; every comparison reads each side once and deals them itself."""
    columns = ("sql_id", "step_id", *listings.COMPARED)
    texts = [ft.plan_texts(spark, d, v) for v in (0, 1)]
    return [plan_text.plan_step_lists(t, columns) if lists else plan_text.plan_steps(t, columns=columns, dealt=False) for t in texts]


@query(
    f"WITH {STEP_SQL}, {_AFTER}, {VERDICT_SQL} SELECT path, sql_id, tot_b AS total_before, tot_a AS total_after, cost_change, "
    "round(cost_pct_change, 6) AS cost_pct_change, improved, full_scans FROM v"
)
def x14_plan_verdict(spark, d):
    v = listings.plan_verdict(*_both(spark, d, lists=False), ["path", "sql_id"])
    return v.select(
        "path",
        "sql_id",
        "total_before",
        "total_after",
        "cost_change",
        F.round("cost_pct_change", 6).alias("cost_pct_change"),
        "improved",
        "full_scans",
    )


@query(
    f"""WITH {STEP_SQL}, {_AFTER}, {COMPARE_SQL}, {VERDICT_SQL}, had AS (SELECT path, sql_id, list(DISTINCT operation) AS ops FROM st
  GROUP BY ALL)
 SELECT path, sql_id, CASE full_scans WHEN 'removed' THEN 'fixed' ELSE 'new' END AS change, 'Full table scan ' || full_scans AS problem
  FROM v WHERE full_scans IS NOT NULL
 UNION ALL SELECT path, sql_id, 'fixed', 'Full scan removed: ' || ob || ' on ' || coalesce(nb, 'None') || ' -> ' || oa FROM m
  JOIN v USING (path, sql_id) WHERE moved AND contains(ob, 'FULL') AND NOT contains(oa, 'FULL') AND NOT (fb AND NOT fa)
 UNION ALL SELECT path, sql_id, 'new', 'New full scan: ' || oa || ' on ' || coalesce(na, 'None') FROM m JOIN v USING (path, sql_id)
  WHERE moved AND NOT contains(ob, 'FULL') AND contains(oa, 'FULL') AND NOT fb
 UNION ALL SELECT path, sql_id, 'access', ob || ' (' || coalesce(nb, 'None') || ') -> ' || oa || ' (' || coalesce(na, 'None') || ')'
  FROM m JOIN had USING (path, sql_id) WHERE moved AND len(list_filter(ops, lambda x: contains(x, oa))) = 0"""
)
def x14_problem_changes(spark, d):
    return listings.problem_changes(*_both(spark, d), ["path", "sql_id"])


_META = "(SELECT 'T' || object_name AS n, * EXCLUDE (object_name), CASE WHEN object_name % 2 = 0 THEN 'A, B' END AS cols FROM meta)"


@query(
    fx.sql(
        f"""SELECT path, sql_id, n AS object_name, severity, pattern, n || detail AS detail FROM (SELECT path, sql_id, n, unnest([
 CASE WHEN analysed_days IS NULL THEN {{'severity': 'HIGH', 'pattern': 'Missing Statistics', 'detail': ': never analyzed'}} END,
 CASE WHEN analysed_days > 30 THEN
  {{'severity': CASE WHEN analysed_days > 90 THEN 'HIGH' ELSE 'MEDIUM' END, 'pattern': 'Stale Statistics', 'detail': ': last analyzed ' || analysed_days || ' days ago'}} END,
 CASE WHEN object_type = 'INDEX' AND clustering_factor / nullif(num_rows, 0) > 0.8 THEN
  {{'severity': CASE WHEN clustering_factor / num_rows > 1.5 THEN 'HIGH' ELSE 'MEDIUM' END, 'pattern': 'High Clustering Factor',
  'detail': ': clustering_factor=' || floor(clustering_factor)::BIGINT || ' / num_rows=' || floor(num_rows)::BIGINT}} END,
 CASE WHEN object_type = 'INDEX' AND blevel >= 4 THEN
  {{'severity': CASE WHEN blevel >= 5 THEN 'HIGH' ELSE 'MEDIUM' END, 'pattern': 'Deep B-tree Index', 'detail': ': blevel=' || blevel}}
  END,
 CASE WHEN object_type = 'INDEX' AND cols IS NOT NULL THEN
  {{'severity': 'INFO', 'pattern': 'Index Definition', 'detail': ' [None]: (' || cols || ')'}} END,
 CASE WHEN object_type = 'TABLE' AND num_rows > 0 THEN
  {{'severity': 'INFO', 'pattern': 'Table Size', 'detail': ': ' || floor(num_rows)::BIGINT || ' rows, ' || coalesce('partitioned (' || partition_type || ')', 'unpartitioned')}} END]) AS w
 FROM (SELECT DISTINCT path, sql_id, object_name FROM st)
  JOIN {_META} ON object_name = n), LATERAL (SELECT w.severity AS severity, w.pattern AS pattern, w.detail AS detail)
  WHERE w IS NOT NULL""",
        "meta",
        ctes=STEP_SQL,
    )
)
def x15_plan_metadata_warnings(spark, d):
    columns = F.when(F.col("object_name") % 2 == 0, F.lit('[{"col":"A","pos":1},{"col":"B","pos":2}]'))
    meta = fx.meta(spark, d).withColumns({"index_columns": columns, "uniqueness": F.lit(None).cast("string")})
    meta = meta.withColumn("object_name", F.concat(F.lit("T"), F.col("object_name").cast("string")))
    steps = plan_text.plan_steps(ft.plan_texts(spark, d), columns=("sql_id", "object_name"), dealt=False)
    return listings.metadata_warnings(steps, meta, ["path", "sql_id"])


@query(
    f"WITH {STEP_SQL} SELECT path, sql_id, step_id, last_value(CASE "
    "WHEN operation LIKE 'TABLE%' THEN object_name END IGNORE NULLS) OVER (PARTITION BY path, sql_id ORDER BY step_id) AS carried "
    "FROM st"
)
def w5_header_carry(spark, d):
    s = plan_text.plan_steps(ft.plan_texts(spark, d), columns=("sql_id", "step_id", "operation", "object_name"), dealt=False)
    head = F.when(F.col("operation").startswith("TABLE"), F.col("object_name"))
    return s.select("path", "sql_id", "step_id", header_carry(head, ["path", "sql_id"], "step_id").alias("carried"))
