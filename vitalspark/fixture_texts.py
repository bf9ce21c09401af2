"""Raw texts that Spark writes from the test tables, so that the sources have logs, reports and plan listings to read at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def host_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a log for each host and day. Every event is a block of a header and a row; odd hosts use the AM/PM clock and older names."""
    e = fx.table(spark, sf_dir, "events").withColumn("h", F.col("user_id") % 5)
    odd = F.col("h") % 2 == 1
    clock = F.when(odd, F.date_format("ts", "hh:mm:ss a")).otherwise(F.date_format("ts", "HH:mm:ss"))
    pick = lambda a, b: F.when(odd, F.lit(b)).otherwise(F.lit(a))
    v, i, u, zero = _s("value"), _s("event_id"), _s("user_id"), F.lit("0.00")
    k = F.col("event_id") % 6
    plain = {
        0: "IFACE rxpck/s txpck/s rxkB/s txkB/s",
        1: "pgpgin/s pgpgout/s fault/s majflt/s",
        2: "proc/s cswch/s",
        3: "runq-sz plist-sz ldavg-1 ldavg-5 ldavg-15",
        4: "kbhugfree kbhugused %hugused",
        5: "totsck tcpsck udpsck",
    }
    head = F.when(
        F.col("event_type") == "click", pick("CPU %usr %nice %sys %iowait %steal %idle", "CPU %user %nice %system %iowait %steal %idle")
    )
    head = head.when(
        F.col("event_type") == "view",
        pick("kbavail kbmemused %memused kbbuffers kbdirty", "kbmemfree kbmemused %memused kbbuffers kbcached"),
    )
    head = head.when(F.col("event_type") == "error", pick("DEV tps rkB/s wkB/s await %util", "DEV tps rd_sec/s wr_sec/s await svctm %util"))
    head = head.when(F.col("event_type") == "purchase", pick("kbswpfree kbswpused %swpused", "kbswpfree kbswpused"))
    other = F.lit("")
    for n, names in plain.items():
        other = F.when(k == n, F.lit(names)).otherwise(other)
    head = head.otherwise(other)
    row = F.when(F.col("event_type") == "click", F.concat_ws(" ", F.lit("all"), v, zero, u, i, zero, v))
    row = row.when(F.col("event_type") == "view", F.concat_ws(" ", i, u, v, F.lit("2048"), i))
    row = row.when(
        F.col("event_type") == "error",
        F.when(odd, F.concat_ws(" ", F.lit("sda"), v, i, u, v, zero, v)).otherwise(F.concat_ws(" ", F.lit("sda"), v, i, u, v, v)),
    )
    row = row.when(F.col("event_type") == "purchase", F.when(odd, F.concat_ws(" ", i, u)).otherwise(F.concat_ws(" ", i, u, v)))
    row = row.otherwise(
        F.when(
            k == 0, F.concat_ws(" ", F.lit("eth0"), v, i, u, v)
        ).when(k == 1, F.concat_ws(" ", v, i, u, v)).when(k == 2, F.concat_ws(" ", v, i)).when(
            k == 3, F.concat_ws(" ", i, u, v, v, v)
        ).otherwise(F.concat_ws(" ", i, u, v))
    )
    block = F.concat(F.lit("\n"), clock, F.lit("     "), head, F.lit("\n"), clock, F.lit("     "), row, F.lit("\nAverage:     "), row)
    g = e.select("h", F.to_date("ts").alias("day"), "event_id", block.alias("b")).groupBy("h", "day").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "b"))), lambda x: x["b"]), "\n").alias("body")
    )
    date = F.when(
        F.col("h") % 3 == 0, F.date_format("day", "MM/dd/yyyy")
    ).when(F.col("h") % 3 == 1, F.date_format("day", "yyyy-MM-dd")).otherwise(F.date_format("day", "MM/dd/yy"))
    return g.select(
        F.concat(F.lit("host"), _s("h"), F.lit("-"), _s("day")).alias("path"),
        F.concat(
            F.lit("Linux 5.4.0 (host"), _s("h"), F.lit(") \t"), date, F.lit(" \t_x86_64_\t(8 CPU)\n"), "body", F.lit("\n")
        ).alias("content"),
    )


def flawed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a log for each host and day with all that may go wrong. By event_id % 8 a row's block is: 1 torn, 2 at 25:61:61, 3 without header,
    4 under a header that repeats a name, 5 cut off from its header by noise, 6 after a restart note. By host: 0 header in the first line, 1 after a
    blank line, 2 after a banner, 3 without any date, 4 in line 9."""
    e = fx.table(spark, sf_dir, "events").withColumns({"h": F.col("user_id") % 5, "k": F.col("event_id") % 8})
    k, clock = F.col("k"), F.date_format("ts", "HH:mm:ss")
    line = lambda t, x: F.concat(t, F.lit("     "), x, F.lit("\n"))
    head = F.when(k == 3, "").otherwise(line(clock, F.when(k == 4, "CPU %user %user %idle").otherwise("CPU %user %nice %idle")))
    noise = F.when(k == 5, "*** buffer lost\n").when(k == 6, line(clock, F.lit("LINUX RESTART (8 CPU)"))).otherwise("")
    cells = F.concat_ws(" ", F.lit("all"), _s("event_id"), _s("user_id"), F.when(k != 1, _s("value")))
    block = F.concat(F.lit("\n"), head, noise, line(F.when(k == 2, "25:61:61").otherwise(clock), cells), F.lit("Average:     0"))
    g = e.select("h", F.to_date("ts").alias("day"), "event_id", block.alias("b")).groupBy("h", "day").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "b"))), lambda x: x["b"]), "\n").alias("body")
    )
    h = F.col("h")
    before = F.when(h == 1, "\n").when(h == 2, "sysstat 12\n").when(h == 4, "\n# x\n" * 4).otherwise("")
    first = F.concat(F.lit("Linux 5.4.0 (host"), _s("h"), F.lit(") \t"), F.when(h != 3, F.date_format("day", "yyyy-MM-dd")).otherwise("today"), F.lit(" \t_x86_64_"))
    return g.select(F.concat(F.lit("host"), _s("h"), F.lit("-"), _s("day")).alias("path"), F.concat(before, first, F.lit("\n"), "body", F.lit("\n")).alias("content"))


def flawed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, lines): two CSV texts of parts with columns in another order, and one that has no sections. Parts that 10 divides stand in torn lines."""
    p = fx.table(spark, sf_dir, "part").select("p_partkey", _s("p_partkey").alias("k"), _s("p_retailprice").alias("v"))
    torn = F.col("p_partkey") % 10 == 0
    one = F.when(torn, F.concat(F.lit("part,"), "k")).otherwise(F.concat_ws(",", F.lit("part"), "k", "v"))
    two = F.when(torn, F.concat_ws(",", "v", F.lit("Part"), "k", F.lit("more"))).otherwise(F.concat_ws(",", "v", F.lit("Part"), "k"))
    file = (F.col("p_partkey") % 3).cast("int")
    row = F.when(file == 0, one).when(file == 1, two).otherwise("nothing,here")
    g = p.select(file.alias("file"), F.struct("p_partkey", row.alias("x")).alias("x")).groupBy("file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["x"]), "\n").alias("body")
    )
    head = F.when(F.col("file") == 0, "Section,Key No.,Amount (%)").when(F.col("file") == 1, "Amount (%),section,Key No.").otherwise("a,b")
    return g.select("file", F.concat(head, F.lit("\n"), "body").alias("lines"))


def _table(summary: str, head: list[str], rows: Column) -> Column:
    return F.concat(
        F.lit(f'<table border="1" summary="{summary}"><tr>' + "".join(f"<th>{h}</th>" for h in head) + "</tr>"), rows, F.lit("</table>")
    )


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a snapshot report for each database, instance and snapshot of the wait view, in both header layouts."""
    w = fx.wait(spark, sf_dir)
    g = w.groupBy("dbname", "instance", "begin_snap", "event").agg(
        F.sum("waits").alias("waits"), F.sum("total_wait_time_s").alias("time"), F.avg("pct").alias("pct"), F.min("snap_time").alias("t")
    )
    unit = F.col("waits") % 3
    ms = F.round("pct", 2)
    cell = F.when(
        unit == 0, F.concat(_s(ms * 1000), F.lit("us"))
    ).when(unit == 1, F.concat(_s(ms), F.lit("ms"))).otherwise(F.concat(_s(ms), F.lit("s")))
    events = _row(F.col("event"), F.format_number("waits", 0), F.format_number("time", 2), cell, F.lit("&#160;"), _s(F.round("pct", 2)))
    g = g.groupBy("dbname", "instance", "begin_snap").agg(
        F.min("t").alias("t"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event", events.alias("r")))), lambda x: x["r"]), "").alias("rows"),
    )
    db, inst, snap = F.concat(F.lit("DB"), _s("dbname")), F.concat(F.lit("DB"), _s("dbname"), _s("instance")), _s("begin_snap")
    rac = F.when(F.col("begin_snap") % 2 == 0, "YES").otherwise("NO")
    one = _table(
        "This table displays database instance information",
        ["DB Name", "DB Id", "Instance", "Inst num", "Release", "RAC"],
        _row(db, F.lit("1"), inst, _s("instance"), F.lit("11.2"), rac),
    )
    two = F.concat(
        _table(
            "This table displays database instance information",
            ["DB Name", "DB Id", "Unique Name", "Release", "RAC", "CDB"],
            _row(db, F.lit("1"), db, F.lit("19.0"), rac, F.lit("YES")),
        ),
        _table(
            "This table displays database instance information",
            ["Instance", "Inst Num", "Startup Time"],
            _row(inst, _s("instance"), F.lit("x")),
        ),
    )
    two = F.concat(two, _table("This table displays container information", ["Con Name"], _row(F.concat(F.lit("pdb$"), snap))))
    snaps = _table(
        "This table displays snapshot information",
        ["", "Snap Id", "Snap Time", "Sessions"],
        _row(F.lit("Begin Snap:"), snap, F.date_format("t", "dd-MMM-yy HH:mm:ss"), F.lit("10")),
    )
    waits = F.concat(
        F.lit('<h3 class="awr">Foreground WAIT Events</h3><p>'),
        _table("waits", ["Event", "Waits", "Total Wait Time (s)", "Avg wait", "Waits /txn", "% DB  time"], F.col("rows")),
    )
    empty = F.lit('<h3>Foreground Wait Class</h3><table><tr><th>Wait Class</th></tr></table>')
    html = F.concat(
        F.lit("<html><head><title>AWR Report for DB: "),
        db,
        F.lit(", Inst: "),
        inst,
        F.lit(", Snaps: "),
        snap,
        F.lit("</title></head><body>"),
        F.when(F.col("instance") % 2 == 0, one).otherwise(two),
        snaps,
        empty,
        waits,
        F.lit("</body></html>"),
    )
    return g.select(
        F.concat_ws("/", F.lit("reports"), db, F.concat(inst, F.lit("_"), snap, F.lit(".html"))).alias("path"), html.alias("content")
    )


OPERATIONS = (
    "TABLE ACCESS FULL",
    "INDEX RANGE SCAN",
    "NESTED LOOPS",
    "INDEX FAST FULL SCAN",
    "HASH JOIN",
    "FIXED TABLE FULL",
    "PARTITIONED TABLE ACCESS FULL",
)


def plan_texts(spark: SparkSession, sf_dir: str, variant: int = 0) -> DataFrame:
    """(path, content): a listing of two plans for each order number pair: a step for each line item. ``variant`` 1 leaves out line 3 and
    changes the access of line 4."""
    li = fx.table(spark, sf_dir, "lineitem").where("l_linenumber <> 3" if variant else "true")
    # Dealt once, by file, and gathered once: the groups of lines and plans are told apart within a file's sorted array.
    each = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    lines = li.select(F.floor(F.col("l_orderkey") / 2).alias("file"), each.alias("x")).repartition("file").groupBy("file").agg(
        F.sort_array(F.collect_list("x")).alias("all")
    )
    head = "-" * 40

    def first_of_line(x: Column, i: Column) -> Column:
        before = F.get("all", i - 1)
        return (i == 0) | ~(before["l_orderkey"].eqNullSafe(x["l_orderkey"]) & before["l_linenumber"].eqNullSafe(x["l_linenumber"]))

    star = lambda x: x["l_linenumber"] % 2 == 0

    def row(x: Column) -> Column:
        op = F.get(
            F.array(*map(F.lit, OPERATIONS)), ((x["l_partkey"] + F.when(x["l_linenumber"] == 4, variant).otherwise(0)) % len(OPERATIONS)).cast("int")
        )
        price = x["l_extendedprice"]
        n = F.when(price >= 50000, F.concat(_s(F.floor(price / 1000)), F.lit("K"))).otherwise(_s(F.floor(price)))
        return F.concat(
            F.when(star(x), "|*").otherwise("| "),
            F.lpad(_s(x["l_linenumber"]), 3, " "),
            F.lit(" |  "),
            op,
            F.lit(" | T"),
            _s(x["l_partkey"] % 50),
            F.lit(" | "),
            n,
            F.lit(" | "),
            _s(x["l_quantity"].cast("int")),
            F.lit(" | "),
            _s(F.floor(price / 5)),
            F.lit(" (3)| 00:00:01 |"),
        )

    pred = lambda x: F.concat(F.lpad(_s(x["l_linenumber"]), 4, " "), F.lit(' - filter("A"='), _s(x["l_partkey"]), F.lit("\n       AND B>1)"))

    def text(own: Column) -> Column:
        order = F.get(own, F.lit(0))["l_orderkey"]
        return F.concat(
            F.lit("SQL_ID  q"),
            _s(order),
            F.lit(f", child number 0\n{head}\nSELECT *\n  FROM t\n\nPlan hash value: "),
            _s(order * 31 + variant),
            F.lit(
                f"\n\n{head}\n| Id  | Operation | Name | Rows | Bytes | Cost (%CPU)| Time |\n{head}\n|   0 | "
                "SELECT STATEMENT |  |  |  | 12 (100)|  |\n"
            ),
            F.array_join(F.transform(own, row), "\n"),
            F.lit(f"\n{head}\n\nPredicate Information (identified by operation id):\n{head}\n\n"),
            F.array_join(F.transform(F.filter(own, star), pred), "\n"),
            F.lit("\n\nNote\n-----\n   - dynamic sampling used\n"),
        )

    # A file's lines are those of two orders, of an even and an odd number.
    own = lines.select("file", F.filter("all", first_of_line).alias("own"))
    odd = lambda x: F.pmod(x["l_orderkey"], F.lit(2)) == 1
    own = own.select("file", F.filter("own", lambda x: ~odd(x)).alias("own0"), F.filter("own", odd).alias("own1"))
    plans = [F.when(F.size(c) > 0, text(F.col(c))) for c in ("own0", "own1")]
    return own.select(_s("file").alias("path"), F.concat_ws("\n", *plans).alias("content"))
