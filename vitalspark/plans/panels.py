"""X11 by name: the panels of the host overview as rows of one table, compiled to one pass for each source table and grain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import select

#: Entities that a panel by device shows, and those of a summary.
BUSIEST, SUMMARY = 5, 20


@dataclass(frozen=True)
class Panel:
    """``values``: measure -> SQL expression. ``grain`` says of what: ``samples`` (each row), ``times`` (all entities of a time), ``period`` (a host's
    whole range), ``newest`` (a host's last row) or ``entities`` (an entity's whole range). ``by``: a mean that picks the host's leading entities."""

    name: str
    table: str
    grain: str
    values: dict[str, str]
    entity: str | None = None
    where: str = "true"
    by: str | None = None
    status: str | None = None


def _device(name: str, column: str) -> Panel:
    return Panel(name, "disk", "samples", {column: column}, "device", by=column)


_ALL, _NO_LOOP = "cpu = 'all'", "iface <> 'lo'"

#: FIXED definitions: what each panel shows, and the limits of a device's status.
PANELS = (
    Panel("cpu_shares", "cpu", "samples", {"user": "usr_pct", "system": "system_pct", "iowait": "iowait_pct", "idle": "idle_pct"}, where=_ALL),
    Panel("cpu_iowait", "cpu", "period", {"iowait": "avg(iowait_pct)"}, where=_ALL),
    Panel("cpu_idle", "cpu", "period", {"idle": "avg(idle_pct)"}, where=_ALL),
    Panel("memory_mb", "memory", "samples", {"used": "mem_used_mb", "free": "mem_free_mb", "cached": "cached_mb", "buffers": "buffers_mb"}),
    Panel("memory_shares", "memory", "samples", {"used": "mem_used_pct", "commit": "commit_pct"}),
    Panel("swap_used_mb", "swap", "samples", {"used": "swap_used_mb"}),
    Panel("swap_used_share", "swap", "period", {"used": "avg(swap_used_pct)"}),
    Panel("swap_free_mb", "swap", "samples", {"free": "swap_free_mb"}),
    Panel("disk_throughput", "disk", "times", {"read": "sum(read_mb_per_sec)", "write": "sum(write_mb_per_sec)"}),
    Panel("disk_util_max", "disk", "times", {"util": "max(util_pct)"}),
    Panel("network_rates", "network", "samples", {"received": "rxkb_per_sec", "sent": "txkb_per_sec"}, "iface", _NO_LOOP),
    Panel("network_util", "network", "samples", {"util": "ifutil_pct"}, "iface", _NO_LOOP),
    Panel("run_queue", "loadavg", "samples", {"queue": "runq_sz", "blocked": "blocked"}),
    Panel("load_average", "loadavg", "samples", {"1": "ldavg_1", "5": "ldavg_5", "15": "ldavg_15"}),
    Panel("context_switches", "ctxswitch", "samples", {"switches": "cswch_per_sec"}),
    Panel("page_faults", "paging", "samples", {"minor": "fault_per_sec", "major": "majflt_per_sec"}),
    Panel("vm_efficiency", "paging", "period", {"efficiency": "avg(vmeff_pct)"}),
    _device("device_read", "read_mb_per_sec"),
    _device("device_write", "write_mb_per_sec"),
    _device("device_await", "await_ms"),
    _device("device_util", "util_pct"),
    _device("device_tps", "tps"),
    Panel(
        "device_summary", "disk", "entities",
        {
            "tps": "avg(tps)", "read": "avg(read_mb_per_sec)", "write": "avg(write_mb_per_sec)", "await": "avg(await_ms)", "service": "avg(svctm_ms)",
            "util": "avg(util_pct)", "peak_util": "max(util_pct)", "peak_await": "max(await_ms)"
        },
        "device", by="util_pct",
        status="case when avg(util_pct) >= 85 then 'saturated' when avg(util_pct) >= 60 then 'high' when avg(await_ms) >= 50 then 'slow' else 'ok' end",
    ),
    Panel("hugepages_used_share", "hugepage", "period", {"used": "avg(hugused_pct)"}),
    Panel("hugepages_free_mb", "hugepage", "period", {"free": "avg(kbhugfree) / 1024"}),
    Panel("hugepages_used_gb", "hugepage", "period", {"used": "avg(kbhugused) / 1048576"}),
    Panel("hugepages_now", "hugepage", "newest", {"free_kb": "kbhugfree", "used_mb": "kbhugused / 1024"}),
    Panel("hugepages_trend", "hugepage", "samples", {"used_mb": "kbhugused / 1024", "free_mb": "kbhugfree / 1024"}),
    Panel("hugepages_share", "hugepage", "samples", {"used": "hugused_pct"}),
    Panel("sockets", "socket", "samples", {"total": "totsck", "tcp": "tcpsck", "udp": "udpsck"}),
    Panel("time_wait", "socket", "samples", {"time_wait": "tcp_tw"}),
    Panel(
        "connection_health", "socket", "samples",
        {"total": "totsck", "time_wait": "tcp_tw", "other": "totsck - tcpsck - udpsck", "time_wait_share": "tcp_tw / nullif(tcpsck, 0) * 100"},
    ),
)


def _long(df: DataFrame, panels: Sequence[Panel], value, at, entity, status=None) -> DataFrame:
    """A row for each measure of each panel. ``value``: (panel, measure) -> column."""
    row = lambda p, m: F.struct(F.lit(p.name).alias("panel"), F.lit(m).alias("measure"), value(p, m).cast("double").alias("value"))
    status = F.lit(None).cast("string") if status is None else status
    cells = F.explode(F.array(*[row(p, m) for p in panels for m in p.values])).alias("c")
    return df.select("hostname", at.alias("at"), entity.cast("string").alias("entity"), status.alias("status"), cells).select(
        "hostname", "c.panel", "at", "entity", "c.measure", "c.value", "status"
    )


def _leading(df: DataFrame, entity: str, by: str, k: int) -> DataFrame:
    means = df.groupBy("hostname", entity).agg(F.avg(by).alias("__m"))
    return select.top_k_per_group(means, ["hostname"], k, F.desc_nulls_last("__m"), F.col(entity)).select("hostname", entity)


def _compiled(d: DataFrame, panels: Sequence[Panel]) -> DataFrame:
    """Panels of one table, grain, filter, entity and lead in one pass."""
    first, none = panels[0], F.lit(None)
    d = d.where(first.where)
    if first.by:
        d = d.join(_leading(d, first.entity, first.by, SUMMARY if first.grain == "entities" else BUSIEST), ["hostname", first.entity], "left_semi")
    entity, no_time = F.col(first.entity) if first.entity else none, none.cast("timestamp_ntz")
    if first.grain == "samples":
        return _long(d, panels, lambda p, m: F.expr(p.values[m]), F.col("snap_time"), entity)
    if first.grain == "newest":
        last = d.groupBy("hostname").agg(F.max_by(F.struct(*d.columns), "snap_time").alias("__r")).select("__r.*")
        return _long(last, panels, lambda p, m: F.expr(p.values[m]), F.col("snap_time"), none)
    keys = {"times": ["snap_time"], "period": [], "entities": [first.entity]}[first.grain]
    named = {(p.name, m): f"__{i}_{j}" for i, p in enumerate(panels) for j, m in enumerate(p.values)}
    aggregates = [F.expr(p.values[m]).alias(named[p.name, m]) for p in panels for m in p.values]
    status = [F.expr(first.status).alias("__status")] if first.status else []
    g = d.groupBy("hostname", *keys).agg(*aggregates, *status)
    at = F.col("snap_time") if first.grain == "times" else no_time
    return _long(g, panels, lambda p, m: F.col(named[p.name, m]), at, entity, F.col("__status") if status else None)


def host_panels(tables: dict[str, DataFrame], start: str, end: str, panels: Sequence[Panel] = PANELS) -> DataFrame:
    """X11: the named panels of every host in a closed range of days as (hostname, panel, at, entity, measure, value, status).

    ``tables``: cpu, memory, swap, disk, network, paging, ctxswitch, loadavg, hugepage, socket, as SRC5 to SRC9 give them; panels of tables that are
    absent are left out. Of several last rows of one time any one counts as the newest. Panels that share table, grain and filter share a scan."""
    groups: dict[tuple, list[Panel]] = {}
    for p in panels:
        if p.table in tables:
            alone = p.name if p.status else None
            groups.setdefault((p.table, p.grain, p.where, p.entity, p.by, alone), []).append(p)
    if not groups:
        raise ValueError("none of the panels' tables is given")
    days = F.to_date("snap_time").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return reduce(DataFrame.unionByName, [_compiled(tables[g[0]].where(days), own) for g, own in groups.items()])
