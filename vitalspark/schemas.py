"""Declared schemas of the fact tables. ``schema(name)`` gives a StructType; snapshot tables share the prefix of their report."""

from __future__ import annotations

from pyspark.sql.types import StructType

SNAPSHOT = "dbname string, instance string, instnum int, snap_time timestamp_ntz, begin_snap int"
HOST = "hostname string, snap_time timestamp_ntz"
_SQL = "sql_id string, sql_module string, executions double, pct_total double"
_WAIT = "waits bigint, total_wait_time_s double, avg_wait_ms double"
_IO = (
    "name string, reads_mb double, reads_reqs_per_sec double, reads_data_per_sec_mb double, writes_mb double, writes_reqs_per_sec "
    "double, writes_data_per_sec_mb double"
)
_SEGMENT = "owner string, tablespace_name string, object_name string, subobject_name string, obj_type string"


def _doubles(*names: str) -> str:
    return ", ".join(f"{n} double" for n in names)


#: Columns after the prefix of snapshot tables.
SNAPSHOT_TABLES = {
    "load_profile": "metric string, " + _doubles("per_sec", "per_transaction"),
    "instance_efficiency": "metric string, value double",
    "io_profile": "metric string, " + _doubles("read_per_sec", "write_per_sec"),
    "time_model_stats": "statistic_name string, " + _doubles("time_s", "pct_of_db_time"),
    "os_statistics": "statistic string, value double",
    "foreground_wait_class": f"wait_class string, {_WAIT}, pct_db_time double",
    "foreground_wait_events": f"event string, {_WAIT}, waits_per_txn double, pct_db_time double",
    "background_wait_events": f"event string, {_WAIT}, waits_per_txn double, pct_bg_time double",
    "sql_elapsed_time": f"{_SQL}, " + _doubles("pct_cpu", "pct_io", "elapsed_time_s", "elapsed_time_per_exec_s"),
    "sql_cpu_time": f"{_SQL}, " + _doubles("pct_cpu", "pct_io", "elapsed_time_s", "cpu_time_s", "cpu_per_exec_s"),
    "sql_user_io_time": f"{_SQL}, " + _doubles("pct_cpu", "pct_io", "elapsed_time_s", "user_io_time_s", "uio_per_exec_s"),
    "sql_gets": f"{_SQL}, " + _doubles("elapsed_time_s", "buffer_gets", "gets_per_exec"),
    "sql_reads": f"{_SQL}, " + _doubles("elapsed_time_s", "physical_reads", "reads_per_exec"),
    "sql_phy_reads_unopt": f"{_SQL}, " + _doubles("unoptimized_read_reqs", "physical_read_reqs", "unoptimized_reqs_per_exec", "pctopt"),
    "sql_executions": f"{_SQL}, " + _doubles("rows_processed", "rows_per_exec"),
    "sql_parsed_calls": f"{_SQL}, " + _doubles("parse_calls", "pct_total_parses"),
    "sql_cluster_wait_time": f"{_SQL}, " + _doubles("pct_clu", "cluster_wait_time_s"),
    "sql_text": "sql_id string, sql_text string",
    "iostat_function": f"{_IO}, waits double, avg_time_ms double",
    "iostat_func_filetype": f"{_IO}, waits double, avg_time_ms double",
    "iostat_filetype": f"{_IO}, small_read_ms double, large_read_ms double",
    "tablespace_io_stats": "tablespace string, "
    + _doubles("reads", "avg_read_sec", "avg_read_ms", "writes", "write_avg_sec", "buffer_waits", "avg_buffer_wait_ms"),
    "file_io_stats": "tablespace string, filename string, "
    + _doubles("reads", "avg_read_sec", "avg_read_ms", "writes", "write_avg_sec", "buffer_waits", "avg_buffer_wait_ms"),
    "advisory_sga": _doubles("sga_target_size_m", "sga_size_factor", "est_db_time_s", "est_physical_reads"),
    "advisory_pga": _doubles(
        "pga_target_est_mb",
        "size_factor",
        "w_a_mb_processed",
        "estd_extra_written_to_disk",
        "estd_pga_cache_hit_pct",
        "estd_pga_overalloc_count",
        "estd_time",
    ),
    "buffer_wait_statistics": "class string, " + _doubles("waits", "total_wait_time_s", "avg_time_ms"),
    "enqueue_statistics": "enqueue_type_request_reason string, "
    + _doubles("requests", "succ_gets", "failed_gets", "waits", "wt_time_s", "av_wt_time_ms"),
    "undo_statistics": _doubles("num_undo_blocks", "number_of_transactions", "max_qry_len_s", "max_tx_concy"),
    "instance_activity_stats": "name string, statistic string, " + _doubles("total", "per_second", "per_trans"),
    "db_info": "db_name string, edition string, release string, rac string, host_name string, platform string, cpus "
    "int, cores int, sockets int, memory_gb double",
}
#: Segment metrics: one table each, ``seg_<metric>``.
SEGMENT_METRICS = (
    "logical_reads",
    "phy_reads",
    "phy_read_req",
    "unopt_reads",
    "opt_reads",
    "direct_phy_reads",
    "phy_writes",
    "phy_write_req",
    "direct_phy_writes",
    "table_scan",
    "db_blk_chg",
    "row_lck_waits",
    "itl_waits",
    "buff_busy_waits",
    "gbl_cache_buff_busy",
    "cr_blk_rec",
    "cur_blk_rec",
    "gc_cr_blk_rec",
)
SNAPSHOT_TABLES |= {f"seg_{m}": f"{_SEGMENT}, {m} double, pcttotal double" for m in SEGMENT_METRICS}
#: Columns after the prefix of host tables.
HOST_TABLES = {
    "sar_cpu": "cpu string, " + _doubles("usr_pct", "nice_pct", "system_pct", "iowait_pct", "steal_pct", "idle_pct"),
    "sar_memory": _doubles("mem_free_mb", "mem_used_mb", "mem_used_pct", "buffers_mb", "cached_mb", "commit_mb", "commit_pct"),
    "sar_swap": _doubles("swap_free_mb", "swap_used_mb", "swap_used_pct"),
    "sar_disk": "device string, " + _doubles("tps", "read_mb_per_sec", "write_mb_per_sec", "await_ms", "svctm_ms", "util_pct"),
    "sar_network": "iface string, "
    + _doubles(
        "rxpck_per_sec", "txpck_per_sec", "rxkb_per_sec", "txkb_per_sec", "rxcmp_per_sec", "txcmp_per_sec", "rxmcst_per_sec", "ifutil_pct"
    ),
    "sar_paging": _doubles(
        "pgpgin_per_sec",
        "pgpgout_per_sec",
        "fault_per_sec",
        "majflt_per_sec",
        "pgfree_per_sec",
        "pgscank_per_sec",
        "pgscand_per_sec",
        "pgsteal_per_sec",
        "vmeff_pct",
    ),
    "sar_loadavg": _doubles("runq_sz", "plist_sz", "ldavg_1", "ldavg_5", "ldavg_15", "blocked"),
    "sar_ctxswitch": _doubles("proc_per_sec", "cswch_per_sec"),
    "sar_hugepage": _doubles("kbhugfree", "kbhugused", "hugused_pct", "kbhugrsvd", "kbhugsurp"),
    "sar_socket": _doubles("totsck", "tcpsck", "udpsck", "rawsck", "ip_frag", "tcp_tw"),
}


def schema(table: str) -> StructType:
    if table in HOST_TABLES:
        return StructType.fromDDL(f"{HOST}, {HOST_TABLES[table]}")
    return StructType.fromDDL(f"{SNAPSHOT}, {SNAPSHOT_TABLES[table]}, row_hash string")
