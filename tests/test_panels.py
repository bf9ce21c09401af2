"""Named host panels on what the test logs lack: many devices, single processors, the loop interface, missing values and tables."""

from datetime import datetime

import pytest

from vitalspark.plans import panels

T = [datetime(2024, 1, d, 10) for d in (1, 2, 3)]


def _by_panel(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["panel"], []).append((r["hostname"], r["at"] and r["at"].day, r["entity"], r["measure"], r["value"], r["status"]))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_names_are_unique():
    assert len({p.name for p in panels.PANELS}) == len(panels.PANELS) == 32


def test_devices_processors_and_interfaces(spark):
    disk = [("h", t, f"d{i}", 1.0 * i, 2.0 * i, None if i == 6 else 10.0 - i, 60.0 - i, None, 84.0 + i) for t in T for i in range(7)]
    cpu = [("h", T[0], "all", 10.0, 1.0, 80.0, 20.0), ("h", T[1], "all", 20.0, 1.0, None, 40.0), ("h", T[1], "0", 99.0, 9.0, 99.0, 99.0)]
    net = [("h", T[0], "lo", 1.0, 1.0, 1.0), ("h", T[0], "eth0", 2.0, 3.0, 4.0)]
    huge = [("h", T[0], 4096.0, 1048576.0, 50.0), ("h", T[1], 2048.0, 2097152.0, 70.0), ("g", T[0], 1024.0, 0.0, 0.0)]
    tables = {
        "disk": spark.createDataFrame(
            disk, "hostname string, snap_time timestamp_ntz, device string, tps double, read_mb_per_sec double, write_mb_per_sec double, await_ms double, svctm_ms double, util_pct double"
        ),
        "cpu": spark.createDataFrame(cpu, "hostname string, snap_time timestamp_ntz, cpu string, usr_pct double, system_pct double, iowait_pct double, idle_pct double"),
        "network": spark.createDataFrame(net, "hostname string, snap_time timestamp_ntz, iface string, rxkb_per_sec double, txkb_per_sec double, ifutil_pct double"),
        "hugepage": spark.createDataFrame(huge, "hostname string, snap_time timestamp_ntz, kbhugfree double, kbhugused double, hugused_pct double"),
    }
    got = _by_panel(panels.host_panels(tables, "2024-01-01", "2024-01-02"))
    assert {p.name for p in panels.PANELS if p.table in tables} == set(got)
    assert {(r[2]) for r in got["device_read"]} == {"d2", "d3", "d4", "d5", "d6"} and len(got["device_read"]) == 10
    assert {(r[2]) for r in got["device_write"]} == {"d0", "d1", "d2", "d3", "d4"}  # the one without a mean comes last
    assert got["disk_throughput"] == [("h", d, None, m, v, None) for d in (1, 2) for m, v in (("read", 42.0), ("write", 45.0))]
    assert [r[4] for r in got["disk_util_max"]] == [90.0, 90.0]
    assert {r[2]: r[5] for r in got["device_summary"]} == {"d0": "high"} | {f"d{i}": "saturated" for i in range(1, 7)}
    assert {r[4] for r in got["device_summary"] if r[3] == "service"} == {None}
    assert got["cpu_iowait"] == [("h", None, None, "iowait", 80.0, None)] and got["cpu_idle"] == [("h", None, None, "idle", 30.0, None)]
    assert got["network_util"] == [("h", 1, "eth0", "util", 4.0, None)]
    assert got["hugepages_now"] == [("g", 1, None, "free_kb", 1024.0, None), ("g", 1, None, "used_mb", 0.0, None), ("h", 2, None, "free_kb", 2048.0, None), ("h", 2, None, "used_mb", 2048.0, None)]
    assert got["hugepages_used_gb"] == [("g", None, None, "used", 0.0, None), ("h", None, None, "used", 1.5, None)]


def test_no_table_is_an_error_and_an_empty_one_is_not(spark):
    with pytest.raises(ValueError):
        panels.host_panels({}, "2024-01-01", "2024-01-02")
    empty = spark.createDataFrame([], "hostname string, snap_time timestamp_ntz, cswch_per_sec double")
    assert panels.host_panels({"ctxswitch": empty}, "2024-01-01", "2024-01-02").count() == 0
