"""Snapshot reports (SRC1-SRC3): HTML files to long rows in one Arrow pass, then typed tables as column expressions.

The pass emits (path, section, row_no, MAP<header, cell>) for every table under a heading, and for tables known by their summary; each file is
parsed once whatever the number of sections. A section config says which heading makes which table with which columns and converters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


class _Tables(HTMLParser):
    """Collects the tables of a report with the heading before them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.heading, self.near, self.text, self.tables = "", "", None, []
        self.table = self.row = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h1", "h2", "h3", "h4", "th", "td"):
            self.text = []
        if tag == "table":
            self.table = {"heading": self.heading or self.near, "summary": dict(attrs).get("summary") or "", "rows": []}
        elif tag == "tr":
            self.row = []

    def handle_endtag(self, tag: str) -> None:
        if self.text is not None and tag in ("h1", "h2", "h3", "h4", "th", "td"):
            value = " ".join("".join(self.text).split())
            self.text = None
            if tag in ("th", "td"):
                if self.row is not None:
                    self.row.append(value)
            else:
                self.heading = value
        elif tag == "tr" and self.table is not None and self.row:
            self.table["rows"].append(self.row)
            self.row = None
        elif tag == "table" and self.table is not None:
            self.tables.append(self.table)
            self.table, self.heading, self.near = None, "", ""

    def handle_data(self, data: str) -> None:
        if self.text is not None:
            self.text.append(data)
        elif self.table is None and data.strip():  # some headings are plain text before their table
            self.near = " ".join(data.split())


#: Rows that leave the parser together.
ROWS_AT_ONCE = 512
#: Characters that are given to the parser together.
FED_AT_ONCE = 1 << 16


def _tables(content: str) -> Iterator[dict]:
    """The tables of a report one after the other, while it is parsed."""
    p = _Tables()
    for i in range(0, len(content), FED_AT_ONCE):
        p.feed(content[i : i + FED_AT_ONCE])
        done, p.tables = p.tables, []
        yield from done


#: Summaries of the tables that tell of the instance and of the snapshots.
INFO = ("database instance information", "snapshot information")
ROWS = (
    "path string, heading string, summary string, table_no int, row_no int, cells map<string,string>, row array<string>, header "
    "map<string,string>"
)
#: What the tables on the instance and on the snapshots say of a report, by header without blanks and case.
HEADER = ("dbname", "instance", "instnum", "snapid", "snaptime")


def _header(tables: Iterable[dict]) -> dict[str, str]:
    plain = lambda x: "".join(x.split()).lower()
    found: dict[str, str] = {}
    seen = set()
    for t in tables:
        head, info = [plain(x) for x in t["rows"][0]] if t["rows"] else [], INFO[0] in t["summary"]
        if not info and INFO[1] not in t["summary"]:
            if len(seen) == 2:  # both kinds stand at the top of a report: the rest needn't be parsed for this
                return found
            continue
        seen.add(info)
        for cells in t["rows"][1:]:
            if info or (cells and cells[0].lower().startswith("begin snap")):
                for name, value in zip(head, cells, strict=False):
                    if name in HEADER and (name[:4] == "snap") != info:
                        found[name] = max(found.get(name, ""), value.strip())
    return found


def report_rows(files: DataFrame) -> DataFrame:
    """Long rows of every table in (path, content). The header row is number -1; ``row`` has the plain cells. Header names are stripped
    of repeated blanks; cells beyond the header are dropped, repeated names keep the last."""

    kind = pa.map_(pa.string(), pa.string())
    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [kind, pa.list_(pa.string()), kind]
    names = ["path", "heading", "summary", "table_no", "row_no", "cells", "row", "header"]

    def rows_of(path: str, content: str) -> Iterator[tuple]:
        header = list(_header(_tables(content)).items())
        for k, t in enumerate(_tables(content)):
            head = t["rows"][0] if t["rows"] else []
            for n, cells in enumerate(t["rows"], start=-1):
                yield path, t["heading"], t["summary"], k, n, list(dict(zip(head, cells, strict=False)).items()), cells, header

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one report at a time, whatever the number of reports in a batch
                path, content = (batch.column(c)[i].as_py() for c in (0, 1))
                rows = rows_of(path, content or "")
                while some := list(islice(rows, ROWS_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, ROWS)


def report_headers(files: DataFrame) -> DataFrame:
    """(path, header) of every report that has a table: one row a report, parsed once and no further than the tables on instance and snapshots, where
    both stand at the top. For what needs the metadata only; no rows leave the parser and nothing is shuffled."""
    kinds = [pa.string(), pa.map_(pa.string(), pa.string())]

    def header_of(content: str) -> list | None:
        tables = _tables(content)
        first = next((t for t in tables if t["rows"]), None)
        return None if first is None else list(_header(chain([first], tables)).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):  # one report at a time, whatever the number of reports in a batch
                path, content = (batch.column(c)[i].as_py() for c in (0, 1))
                if (header := header_of(content or "")) is not None:
                    found.append((path, header))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], ["path", "header"])

    return files.select("path", "content").mapInArrow(run, "path string, header map<string,string>")


def read_reports(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(path, content) of report files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(
        "path", F.col("content").cast("string").alias("content")
    )


@dataclass(frozen=True)
class Section:
    """heading -> table: output column -> (header, converter)."""

    heading: str
    table: str
    columns: dict[str, tuple[str, Callable[[Column], Column]]] = field(default_factory=dict)


_text = lambda c: S.sanitize(F.trim(c))
_SQL = {
    "sql_id": ("SQL Id", _text),
    "sql_module": ("SQL Module", _text),
    "executions": ("Executions", S.clean_number),
    "pct_total": ("%Total", S.clean_number),
}
_WAITS = {
    "event": ("Event", _text),
    "waits": ("Waits", S.to_count),
    "total_wait_time_s": ("Total Wait Time (s)", S.clean_number),
    "avg_wait_ms": ("Avg wait", S.to_ms),
}


def _segment(table: str, heading: str, metric: str, header: str) -> Section:
    own = {
        "owner": "Owner",
        "tablespace_name": "Tablespace Name",
        "object_name": "Object Name",
        "subobject_name": "Subobject Name",
        "obj_type": "Obj. Type",
    }
    return Section(
        heading, table, {k: (h, _text) for k, h in own.items()} | {metric: (header, S.to_count), "pcttotal": ("%Total", S.clean_number)}
    )


def _sql(table: str, heading: str, **columns: str) -> Section:
    return Section(heading, table, _SQL | {k: (h, S.clean_number) for k, h in columns.items()})


#: Sections of a report. Headings and column names are those that the reports print.
SECTIONS = [
    Section("Foreground Wait Events", "foreground_wait_events", _WAITS | {"pct_db_time": ("% DB time", S.clean_number)}),
    Section("Background Wait Events", "background_wait_events", _WAITS | {"pct_bg_time": ("% bg time", S.clean_number)}),
    Section(
        "Foreground Wait Class",
        "foreground_wait_class",
        {
            "wait_class": ("Wait Class", _text),
            "waits": ("Waits", S.to_count),
            "total_wait_time_s": ("Total Wait Time (s)", S.clean_number),
            "avg_wait_ms": ("Avg wait", S.to_ms),
            "pct_db_time": ("%DB time", S.clean_number),
        },
    ),
    Section(
        "Buffer Wait Statistics",
        "buffer_wait_statistics",
        {
            "class": ("Class", _text),
            "waits": ("Waits", S.to_count),
            "total_wait_time_s": ("Total Wait Time (s)", S.clean_number),
            "avg_time_ms": ("Avg Time (ms)", S.clean_number),
        },
    ),
    Section(
        "Enqueue Activity",
        "enqueue_statistics",
        {
            "enqueue_type_request_reason": ("Enqueue Type (Request Reason)", _text),
            "requests": ("Requests", S.clean_number),
            "succ_gets": ("Succ Gets", S.clean_number),
            "failed_gets": ("Failed Gets", S.clean_number),
            "waits": ("Waits", S.clean_number),
            "wt_time_s": ("Wt Time (s)", S.clean_number),
            "av_wt_time_ms": ("Av Wt Time(ms)", S.clean_number),
        },
    ),
    Section(
        "Time Model Statistics",
        "time_model_stats",
        {
            "statistic_name": ("Statistic Name", _text),
            "time_s": ("Time (s)", S.clean_number),
            "pct_of_db_time": ("% of DB Time", S.clean_number),
        },
    ),
    Section("Operating System Statistics", "os_statistics", {"statistic": ("Statistic", _text), "value": ("Value", S.clean_number)}),
    Section(
        "Key Instance Activity Stats",
        "instance_activity_stats",
        {
            "statistic": ("Statistic", _text),
            "total": ("Total", S.clean_number),
            "per_second": ("per Second", S.clean_number),
            "per_trans": ("per Trans", S.clean_number),
        },
    ),
    Section(
        "SGA Target Advisory",
        "advisory_sga",
        {
            "sga_target_size_m": ("SGA Target Size (M)", S.clean_number),
            "sga_size_factor": ("SGA Size Factor", S.clean_number),
            "est_db_time_s": ("Est DB Time (s)", S.clean_number),
            "est_physical_reads": ("Est Physical Reads", S.clean_number),
        },
    ),
    Section(
        "PGA Memory Advisory",
        "advisory_pga",
        {
            "pga_target_est_mb": ("PGA Target Est (MB)", S.clean_number),
            "size_factor": ("Size Factr", S.clean_number),
            "w_a_mb_processed": ("W/A MB Processed", S.clean_number),
            "estd_extra_written_to_disk": ("Estd Extra W/A MB Read/ Written to Disk", S.clean_number),
            "estd_pga_cache_hit_pct": ("Estd PGA Cache Hit %", S.clean_number),
            "estd_pga_overalloc_count": ("Estd PGA Overalloc Count", S.clean_number),
        },
    ),
    Section(
        "IOStat by Function summary",
        "iostat_function",
        {
            "name": ("Function Name", _text),
            "reads_mb": ("Reads: Data", S.to_mb),
            "reads_reqs_per_sec": ("Reqs per sec", S.clean_number),
            "writes_mb": ("Writes: Data", S.to_mb),
            "waits": ("Waits: Count", S.to_count),
            "avg_time_ms": ("Avg Time", S.to_ms),
        },
    ),
    Section(
        "Tablespace IO Stats",
        "tablespace_io_stats",
        {
            "tablespace": ("Tablespace", _text),
            "reads": ("Reads", S.clean_number),
            "avg_read_ms": ("Av Rd(ms)", S.clean_number),
            "writes": ("Writes", S.clean_number),
            "buffer_waits": ("Buffer Waits", S.clean_number),
        },
    ),
    Section(
        "IO Profile",
        "io_profile",
        {
            "metric": ("", _text),
            "read_per_sec": ("Read per Second", S.clean_number),
            "write_per_sec": ("Write per Second", S.clean_number),
        },
    ),
    Section(
        "IOStat by Filetype summary",
        "iostat_filetype",
        {
            "name": ("Filetype Name", _text),
            "reads_mb": ("Reads: Data", S.to_mb),
            "reads_reqs_per_sec": ("Reqs per sec", S.clean_number),
            "writes_mb": ("Writes: Data", S.to_mb),
            "small_read_ms": ("Small Read", S.to_ms),
            "large_read_ms": ("Large Read", S.to_ms),
        },
    ),
    Section(
        "IOStat by Function/Filetype summary",
        "iostat_func_filetype",
        {
            "name": ("Function/File Name", _text),
            "reads_mb": ("Reads: Data", S.to_mb),
            "reads_reqs_per_sec": ("Reqs per sec", S.clean_number),
            "writes_mb": ("Writes: Data", S.to_mb),
            "waits": ("Waits: Count", S.to_count),
            "avg_time_ms": ("Avg Time", S.to_ms),
        },
    ),
    Section(
        "File IO Stats",
        "file_io_stats",
        {
            "tablespace": ("Tablespace", _text),
            "filename": ("Filename", _text),
            "reads": ("Reads", S.clean_number),
            "avg_read_ms": ("Av Rd(ms)", S.clean_number),
            "writes": ("Writes", S.clean_number),
            "buffer_waits": ("Buffer Waits", S.clean_number),
            "avg_buffer_wait_ms": ("Av Buf Wt(ms)", S.clean_number),
        },
    ),
    Section(
        "Undo Segment Stats",
        "undo_statistics",
        {
            "num_undo_blocks": ("Num Undo Blocks", S.to_count),
            "number_of_transactions": ("Number of Transactions", S.to_count),
            "max_qry_len_s": ("Max Qry Len (s)", S.clean_number),
            "max_tx_concy": ("Max Tx Concy", S.clean_number),
        },
    ),
    Section("Complete List of SQL Text", "sql_text", {"sql_id": ("SQL Id", _text), "sql_text": ("SQL Text", _text)}),
    _sql(
        "sql_elapsed_time",
        "SQL ordered by Elapsed Time",
        elapsed_time_s="Elapsed Time (s)",
        elapsed_time_per_exec_s="Elapsed Time per Exec (s)",
        pct_cpu="%CPU",
        pct_io="%IO",
    ),
    _sql(
        "sql_cpu_time",
        "SQL ordered by CPU Time",
        cpu_time_s="CPU Time (s)",
        cpu_per_exec_s="CPU per Exec (s)",
        elapsed_time_s="Elapsed Time (s)",
    ),
    _sql("sql_user_io_time", "SQL ordered by User I/O Wait Time", user_io_time_s="User I/O Time (s)", uio_per_exec_s="UIO per Exec (s)"),
    _sql("sql_gets", "SQL ordered by Gets", buffer_gets="Buffer Gets", gets_per_exec="Gets per Exec"),
    _sql("sql_reads", "SQL ordered by Reads", physical_reads="Physical Reads", reads_per_exec="Reads per Exec"),
    _sql(
        "sql_phy_reads_unopt",
        "SQL ordered by Physical Reads (UnOptimized)",
        unoptimized_read_reqs="UnOptimized Read Reqs",
        physical_read_reqs="Physical Read Reqs",
        unoptimized_reqs_per_exec="UnOptimized Reqs per Exec",
        pctopt="%Opt",
    ),
    _sql("sql_executions", "SQL ordered by Executions", rows_processed="Rows Processed", rows_per_exec="Rows per Exec"),
    _sql("sql_parsed_calls", "SQL ordered by Parse Calls", parse_calls="Parse Calls", pct_total_parses="% Total Parses"),
    _sql("sql_cluster_wait_time", "SQL ordered by Cluster Wait Time", cluster_wait_time_s="Cluster Wait Time (s)", pct_clu="%Clu"),
    *[
        _segment(f"seg_{metric}", f"Segments by {words}", metric, words if header is None else header)
        for metric, words, header in (
            ("logical_reads", "Logical Reads", None),
            ("phy_reads", "Physical Reads", None),
            ("phy_read_req", "Physical Read Requests", "Phys Read Requests"),
            ("unopt_reads", "UnOptimized Reads", None),
            ("opt_reads", "Optimized Reads", None),
            ("direct_phy_reads", "Direct Physical Reads", "Direct Reads"),
            ("phy_writes", "Physical Writes", None),
            ("phy_write_req", "Physical Write Requests", "Phys Write Requests"),
            ("direct_phy_writes", "Direct Physical Writes", "Direct Writes"),
            ("table_scan", "Table Scans", None),
            ("db_blk_chg", "DB Blocks Changes", "DB Block Changes"),
            ("row_lck_waits", "Row Lock Waits", None),
            ("itl_waits", "ITL Waits", None),
            ("buff_busy_waits", "Buffer Busy Waits", None),
            ("gbl_cache_buff_busy", "Global Cache Buffer Busy", "GC Buffer Busy"),
            ("cr_blk_rec", "CR Blocks Received", None),
            ("cur_blk_rec", "Current Blocks Received", None),
            ("gc_cr_blk_rec", "Global Cache CR Blocks Received", None),
        )
    ],
]
#: Tables known by what their summary says, not by a heading.
SUMMARIES = [
    Section(
        "This table displays database instance information",
        "db_info",
        {
            "db_name": ("DB Name", _text),
            "edition": ("Edition", _text),
            "release": ("Release", _text),
            "instance_name": ("Instance", _text),
            "rac": ("RAC", _text),
        },
    ),
    Section(
        "This table displays load profile",
        "load_profile",
        {"metric": ("", _text), "per_sec": ("Per Second", S.clean_number), "per_transaction": ("Per Transaction", S.clean_number)},
    ),
]


def _cell(header: str) -> Column:
    """The cell of a header, blanks and case aside."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\s ]+", ""))
    found = F.filter(F.map_entries("cells"), lambda e: plain(e["key"]) == header.lower().replace(" ", ""))
    return F.trim(F.regexp_replace(F.try_element_at(found, F.lit(1))["value"], " ", " "))


def section(rows: DataFrame, s: Section) -> DataFrame:
    """SRC1: the typed rows of a section; the heading matches exactly or, failing that in a file, as a part, case aside. Rows without any
    value are left out. A file without the section gives no row."""
    want = s.heading.lower()
    h = F.lower(F.col("summary") if s in SUMMARIES else F.col("heading"))
    d = rows.where((F.col("row_no") >= 0) & F.contains(h, F.lit(want))).withColumn("__exact", h == want)
    from pyspark.sql import Window as W

    d = d.withColumn("__best", F.max("__exact").over(W.partitionBy("path"))).where("__exact = __best")
    d = d.withColumn("__first", F.min("table_no").over(W.partitionBy("path"))).where("table_no = __first")
    out = d.select("path", "row_no", "header", *[convert(_cell(header)).alias(c) for c, (header, convert) in s.columns.items()])
    return out.where(F.coalesce(*[F.col(c).cast("string") for c in s.columns]).isNotNull())


def efficiency(rows: DataFrame) -> DataFrame:
    """SRC1, instance efficiency: a table without header whose cells are pairs of metric and value."""
    r = rows.where(F.contains(F.lower("heading"), F.lit("instance efficiency percentages")))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("row") / 2).cast("int") - 1)),
        lambda i: F.struct(F.get("row", 2 * i).alias("m"), F.get("row", 2 * i + 1).alias("v")),
    )
    d = r.select("path", F.explode(pairs).alias("p"))
    return d.select(
        "path", F.nullif(F.regexp_replace(F.trim("p.m"), r"\s*:$", ""), F.lit("")).alias("metric"), S.clean_number("p.v").alias("value")
    ).where("metric is not null and value is not null")


def _header_columns() -> dict[str, Column]:
    at = lambda name: F.nullif(F.col("header")[name], F.lit(""))
    return {
        "dbname": at("dbname"),
        "instance": at("instance"),
        "instnum": at("instnum").try_cast("int"),
        "begin_snap": at("snapid").try_cast("int"),
        "snap_time": S.day_first_time(at("snaptime")),
    }


_KNOWN = "map_contains_key(header, 'dbname') or map_contains_key(header, 'snapid')"


def metadata(rows: DataFrame) -> DataFrame:
    """SRC2: (path, dbname, instance, instnum, begin_snap, snap_time) from the one-table or two-table header and the snapshot table."""
    one = rows.groupBy("path").agg(F.first("header").alias("header"))
    return one.where(_KNOWN).select("path", *[c.alias(n) for n, c in _header_columns().items()])


def _flaws() -> Column:
    at = lambda name: F.nullif(F.col("header")[name], F.lit(""))
    found = lambda bad, reason, text: F.when(bad, F.struct(F.lit(reason).alias("reason"), text.alias("text")))
    time = at("snaptime")
    return F.array_compact(F.array(
        found(at("dbname").isNull() | at("instance").isNull(), "no instance", at("dbname")),
        found(at("snapid").try_cast("int").isNull(), "no snapshot", at("snapid")),
        found(time.isNotNull() & S.day_first_time(time).isNull(), "bad snap time", time),
    ))


def metadata_rejects(rows: DataFrame) -> DataFrame:
    """(path, reason, text) of reports whose metadata is not whole: ``no instance``, ``no snapshot`` or ``bad snap time``, one row for each."""
    one = rows.groupBy("path").agg(F.first("header").alias("header"))
    return one.select("path", F.explode(_flaws()).alias("r")).select("path", "r.*")


def checked_metadata(files: DataFrame) -> DataFrame:
    """SRC2 with its flaws, from files: ``metadata`` and for each of a report's ``metadata_rejects`` a row with reason and text, or one row with nulls.
    One pass that parses each report once; paths are taken to be distinct."""
    d = report_headers(files).where(_KNOWN).select("path", *[c.alias(n) for n, c in _header_columns().items()], F.explode_outer(_flaws()).alias("r"))
    return d.select(*[c for c in d.columns if c != "r"], "r.reason", "r.text")


def facts_of(rows: DataFrame, table: str) -> DataFrame:
    """SRC1 and SRC2: the rows of one table with their report's metadata and row hash, from parsed rows (``report_rows``). Parsed
    rows that are written once serve every table."""
    s = next(x for x in [*SECTIONS, *SUMMARIES] if x.table == table)
    out = section(rows, s).withColumns(_header_columns()).withColumn("row_hash", S.row_hash(list(s.columns)))
    return out.select("dbname", "instance", "instnum", "snap_time", "begin_snap", *s.columns, "row_hash")


def facts(files: DataFrame, table: str) -> DataFrame:
    """SRC1 and SRC2 from files; each file is parsed once."""
    return facts_of(report_rows(files), table)


def header_probe(files: DataFrame) -> DataFrame:
    """SRC3: what the first 8 KB say: names, instance number, release, whether the database is clustered (RAC) and a container (CDB), and the
    pluggable database. The name falls back from title to file name to folder; flags are read from their own column, absent ones are false."""
    head = F.substring("content", 1, 8192)
    cut = lambda tag: rf"(?is)<{tag}\b[^>]*>\s*(.*?)\s*</{tag}>"
    plain = lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>|&nbsp;|&#160;", " "), r"\s+", ""))
    d = files.select("path", head.alias("head"))
    d = d.withColumn("tables", F.regexp_extract_all("head", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)))
    both = lambda t: F.struct(
        F.transform(F.regexp_extract_all(t, F.lit(cut("th")), F.lit(1)), plain).alias("names"),
        F.regexp_extract_all(t, F.lit(cut("td")), F.lit(1)).alias("cells"),
    )
    d = d.withColumn("tables", F.transform("tables", both))

    def value(name: str) -> Column:
        at = lambda t: F.get(t["cells"], F.array_position(t["names"], F.lit(name)).cast("int") - 1)
        found = F.filter(F.transform(F.filter("tables", lambda t: F.array_contains(t["names"], name)), at), lambda x: x.isNotNull())
        return F.nullif(F.upper(F.trim(F.get(found, F.lit(0)))), F.lit(""))

    given = lambda c, p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    name = r"(?is)DB:\s*([A-Z0-9$#_]+).*?Inst:\s*([A-Z0-9$#_]+)"
    file, folder = given("path", r"([^/]+?)(?:_\d+)?\.html?$"), given("path", r"([^/]+)/[^/]*$")
    pdb = value("CONNAME")
    return d.select(
        "path",
        F.coalesce(F.upper(given("head", name)), file, folder).alias("dbname"),
        folder.alias("folder"),
        F.upper(given("head", name, 2)).alias("instance"),
        value("INSTNUM").try_cast("int").alias("instnum"),
        given("head", r">(\d{1,2}\.\d[\d.]*)<").alias("release"),
        (F.coalesce(value("RAC"), F.lit("")) == "YES").alias("rac"),
        (F.coalesce(value("CDB"), F.lit("")) == "YES").alias("cdb"),
        F.when(pdb != "CDB$ROOT", pdb).alias("pdb"),
    )
