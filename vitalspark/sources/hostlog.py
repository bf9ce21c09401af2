"""Host activity logs (SRC4-SRC10): a text per host and day to typed rows, in DataFrame expressions only.

A file's lines are numbered within it; lines without a time end a block, and the last header line of a block names the columns
of the rows that follow (W5). Name and date are sought in the first ten lines, below the line split; the rest is one window over one file's
lines, so the work grows with a file's length and files spread over tasks.

No line ends a job: a line that can't be read comes out of the same pass with the reason (``classified_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import last_named, try_clock
from ..operators.select import header_carry

_TIME = r"^\d{1,2}:\d{2}:\d{2}$"
_DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}/\d{2}/\d{2}(?!\d)"
#: What every text that casts to a number begins with.
_NUMBER_LIKE = r"^[\s\x00-\x20\x7f-\x9f]*[-+]?(?:[.0-9]|(?i:nan|inf))"
#: The name of hosts whose log gives none.
UNKNOWN = "UNKNOWN_HOST"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def log_day(header: Column) -> Column:
    """Year, month and day of a line with ``yyyy-mm-dd``, ``mm/dd/yyyy`` or ``mm/dd/yy``; nulls without one."""
    number = lambda p, g: F.regexp_extract(header, p, g).try_cast("int")
    iso, us = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{2})/(\d{2})/(\d{4}|\d{2}(?!\d))"
    year = number(us, 3)
    year = F.when(year < 100, year + 2000).otherwise(year)
    dated = F.struct(number(us, 1).alias("m"), number(us, 2).alias("d"))
    return F.struct(
        F.coalesce(number(iso, 1), year).alias("y"), F.coalesce(number(iso, 2), dated["m"]).alias("m"), F.coalesce(number(iso, 3), dated["d"]).alias("d")
    )


def no_number(cell: Column) -> Column:
    """Whether a cell can't be cast to a number. A cast that fails costs an exception, so it is left to cells that begin like a number."""
    return ~cell.rlike(_NUMBER_LIKE) | cell.try_cast("double").isNull()


def classified_lines(files: DataFrame, shift: str | None = None) -> DataFrame:
    """Every line that is data or can't be read: path, line_no (from 1), hostname, snap_time, section, fields, reason, line.

    ``reason`` is null for a row as SRC4 gives it; ``line`` is there where a reason is. Reasons, the first that holds:
    ``no date`` (none in the first ten lines), ``bad time``, ``no header`` (none in the row's block), ``few cells`` (fewer than names: a torn line),
    ``unreadable`` (neither timed, blank, a sum line nor within the first ten). Restart notes are passed over. A name that a header repeats
    stands for its last cell; cells beyond the names are dropped."""
    top = F.slice(F.split("content", "\r?\n", 11), 1, 10)
    head = F.coalesce(F.get(F.filter(top, lambda x: x.rlike(_DATE)), F.lit(0)), F.lit(""))
    name = F.coalesce(F.nullif(F.trim(F.regexp_extract(head, r"\(([^)]*)\)", 1)), F.lit("")), F.lit(UNKNOWN))
    heads = files.select("path", name.alias("hostname"), log_day(head).alias("day"), "content")
    lines = heads.select("path", "hostname", "day", F.posexplode(F.split("content", "\r?\n")).alias("no", "line"))  # the content stays below
    words = lines.select("path", "hostname", "day", "no", "line", F.split(F.trim(F.translate("line", "\t", " ")), " +").alias("w"))
    timed = F.element_at("w", 1).rlike(_TIME)
    half = F.when(F.upper(F.get("w", F.lit(1))).isin("AM", "PM"), F.upper(F.get("w", F.lit(1))))
    d = words.select("path", "hostname", "day", "no", "line", "w", timed.alias("timed"), F.when(timed, half).alias("half"))
    skip = F.when(F.col("half").isNull(), 2).otherwise(3)
    d = d.withColumn("cells", F.when(F.col("timed"), F.slice("w", skip, F.greatest(F.size("w") - skip + 1, F.lit(0)))))
    restart = F.coalesce(F.array_contains("cells", "RESTART"), F.lit(False))
    d = d.where(~restart).withColumn("is_header", F.col("timed") & (F.size("cells") > 0) & F.forall("cells", no_number))
    # What a header names holds until the next header or the end of its block: one running value over the file's lines.
    none = F.lit(None).cast("array<string>")
    mark = F.when(F.col("is_header"), F.struct(F.col("cells").alias("names"))).when(~F.col("timed"), F.struct(none.alias("names")))
    d = d.withColumn("names", header_carry(mark, ["path"], "no")["names"])
    average = F.startswith(F.lower(F.element_at("w", 1)), F.lit("average:"))
    odd = ~F.col("timed") & (F.element_at("w", 1) != "") & ~average & (F.col("no") >= 10)
    rows = d.where((F.col("timed") & ~F.col("is_header")) | odd)
    clock = try_clock(F.col("day"), F.element_at("w", 1), F.col("half"))
    if shift:
        clock = clock + F.expr(f"INTERVAL {shift}")
    rows = rows.withColumn("snap_time", F.when(F.col("timed"), clock))
    reason = F.when(
        ~F.col("timed"), "unreadable"
    ).when(F.col("day.y").isNull(), "no date").when(F.col("snap_time").isNull(), "bad time").when(
        F.col("names").isNull(), "no header"
    ).when(F.size("cells") < F.size("names"), "few cells")
    rows = rows.withColumn("reason", reason)
    good = F.col("reason").isNull()
    return rows.select(
        "path", (F.col("no") + 1).alias("line_no"), "hostname", "snap_time", F.when(good, F.col("names")[0]).alias("section"),
        F.when(good, last_named("names", "cells")).alias("fields"), "reason", F.when(~good, F.col("line")).alias("line")
    )


def log_lines(files: DataFrame, shift: str | None = None) -> DataFrame:
    """SRC4: (path, hostname, snap_time, section, fields) of every row that can be read; ``section`` is the header's first name, ``fields`` a map.

    ``shift`` (SRC10) is an interval text, such as ``5 hours 30 minutes``, added to every time; days roll over."""
    return classified_lines(files, shift).where("reason is null").select("path", "hostname", "snap_time", "section", "fields")


def rejected_lines(files: DataFrame) -> DataFrame:
    """(path, hostname, line_no, reason, line) of the lines that SRC4 leaves out. To have both from one pass, write ``classified_lines``."""
    return classified_lines(files).where("reason is not null").select("path", "hostname", "line_no", "reason", "line")


def field(*names: str, default: float | None = 0.0, scale: float = 1.0, digits: int | None = None) -> Column:
    """The first of the named fields that a row has, as a number."""
    v = F.coalesce(*[F.col("fields")[n].try_cast("double") for n in names])
    v = v if default is None else F.coalesce(v, F.lit(default))
    v = v / scale if scale != 1.0 else v
    return v if digits is None else F.round(v, digits)


def cpu(rows: DataFrame) -> DataFrame:
    """SRC5"""
    f = {
        "usr_pct": ("%user", "%usr"),
        "nice_pct": ("%nice",),
        "system_pct": ("%system", "%sys"),
        "iowait_pct": ("%iowait",),
        "steal_pct": ("%steal",),
        "idle_pct": ("%idle",),
    }
    return rows.where("section = 'CPU'").select(
        "hostname", "snap_time", F.col("fields")["CPU"].alias("cpu"), *[field(*v).alias(k) for k, v in f.items()]
    )


def memory(rows: DataFrame) -> DataFrame:
    """SRC6: kilobytes to megabytes; older and newer names."""
    r = rows.where("map_contains_key(fields, 'kbmemfree') or map_contains_key(fields, 'kbavail')")
    mb = lambda *n: field(*n, scale=1024.0, digits=3)
    return r.select(
        "hostname",
        "snap_time",
        mb("kbmemfree", "kbavail").alias("mem_free_mb"),
        mb("kbmemused").alias("mem_used_mb"),
        field("%memused").alias("mem_used_pct"),
        mb("kbbuffers").alias("buffers_mb"),
        mb("kbcached", "kbdirty").alias("cached_mb"),
        mb("kbcommit").alias("commit_mb"),
        field("%commit").alias("commit_pct"),
    )


def swap(rows: DataFrame) -> DataFrame:
    """SRC7: the share is computed where the log has none; 0 of nothing is 0."""
    r = rows.where("map_contains_key(fields, 'kbswpfree')")
    free, used = field("kbswpfree"), field("kbswpused")
    pct = F.coalesce(field("%swpused", default=None), F.coalesce(used / F.nullif(free + used, F.lit(0.0)) * 100, F.lit(0.0)))
    return r.select(
        "hostname",
        "snap_time",
        F.round(free / 1024, 3).alias("swap_free_mb"),
        F.round(used / 1024, 3).alias("swap_used_mb"),
        pct.alias("swap_used_pct"),
    )


def disk(rows: DataFrame) -> DataFrame:
    """SRC8: kilobytes or 512-byte sectors a second to megabytes; the service time may be missing."""
    r = rows.where("section = 'DEV'")
    rate = lambda kb, sec: F.round(F.coalesce(field(kb, default=None) / 1024, field(sec, default=None) / 2048, F.lit(0.0)), 4)
    return r.select(
        "hostname",
        "snap_time",
        F.col("fields")["DEV"].alias("device"),
        field("tps").alias("tps"),
        rate("rkB/s", "rd_sec/s").alias("read_mb_per_sec"),
        rate("wkB/s", "wr_sec/s").alias("write_mb_per_sec"),
        field("await").alias("await_ms"),
        field("svctm", default=None).alias("svctm_ms"),
        field("%util").alias("util_pct"),
    )


#: SRC9: section's telling field -> (entity field or None, output columns).
PLAIN = {
    "network": (
        "rxpck/s",
        "IFACE",
        {
            "rxpck_per_sec": "rxpck/s",
            "txpck_per_sec": "txpck/s",
            "rxkb_per_sec": "rxkB/s",
            "txkb_per_sec": "txkB/s",
            "rxcmp_per_sec": "rxcmp/s",
            "txcmp_per_sec": "txcmp/s",
            "rxmcst_per_sec": "rxmcst/s",
            "ifutil_pct": "%ifutil",
        },
    ),
    "paging": (
        "pgpgin/s",
        None,
        {
            "pgpgin_per_sec": "pgpgin/s",
            "pgpgout_per_sec": "pgpgout/s",
            "fault_per_sec": "fault/s",
            "majflt_per_sec": "majflt/s",
            "pgfree_per_sec": "pgfree/s",
            "pgscank_per_sec": "pgscank/s",
            "pgscand_per_sec": "pgscand/s",
            "pgsteal_per_sec": "pgsteal/s",
            "vmeff_pct": "%vmeff",
        },
    ),
    "ctxswitch": ("cswch/s", None, {"proc_per_sec": "proc/s", "cswch_per_sec": "cswch/s"}),
    "loadavg": (
        "runq-sz",
        None,
        {
            "runq_sz": "runq-sz",
            "plist_sz": "plist-sz",
            "ldavg_1": "ldavg-1",
            "ldavg_5": "ldavg-5",
            "ldavg_15": "ldavg-15",
            "blocked": "blocked",
        },
    ),
    "hugepage": (
        "kbhugfree",
        None,
        {
            "kbhugfree": "kbhugfree",
            "kbhugused": "kbhugused",
            "hugused_pct": "%hugused",
            "kbhugrsvd": "kbhugrsvd",
            "kbhugsurp": "kbhugsurp",
        },
    ),
    "socket": (
        "totsck",
        None,
        {"totsck": "totsck", "tcpsck": "tcpsck", "udpsck": "udpsck", "rawsck": "rawsck", "ip_frag": "ip-frag", "tcp_tw": "tcp-tw"},
    ),
}


def plain(rows: DataFrame, kind: str) -> DataFrame:
    """SRC9: network, paging, ctxswitch, loadavg, hugepage or socket; absent columns are 0."""
    telling, entity, columns = PLAIN[kind]
    r = rows.where(F.map_contains_key("fields", F.lit(telling)))
    own = [F.col("fields")[entity].alias("iface")] if entity else []
    return r.select("hostname", "snap_time", *own, *[field(v).alias(k) for k, v in columns.items()])
