"""Execution-plan listings (SRC11): text to one row a plan, and to one row a step.

A file is cut at its ``SQL_ID`` lines into plans, and what a heading or header says holds for the lines behind it. ``plan_steps`` reads the lines of many
files at once as Arrow arrays; column expressions make numbers of the cells. Lines are never shuffled: only finished steps are, dealt once, by file, or as their reader needs them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plan_cost, plan_size

#: The rest of a line as ``.*$`` takes it in Java: none of its other line ends but a last one.
_REST = "([^\n\r\x85  ]*)[\r\x85  ]?\\Z"
_SQL_ID, _HASH = re.compile(r"\s*SQL_ID:?\s+(\w+)", re.A), re.compile(r"Plan hash value:\s*(\d+)", re.A)
#: The same for RE2.
_SQL_ID_OF, _HASH_OF = r"^[\s\v]*SQL_ID:?[\s\v]+(?P<x>\w+)", r"Plan hash value:[\s\v]*(?P<x>[0-9]+)"
_PREDICATE, _NOTE = re.compile(r"\s*(\d+)\s+-\s+" + _REST, re.A), re.compile(r"\s+- ", re.A)
_NOTED, _STEP = re.compile(r"\s+- " + _REST, re.A), re.compile(r"\*?\s*\d+\s?\Z", re.A)
_BLANK, _FIRST = " \t\n\x0b\f\r\x85\u2028\u2029", tuple("SPN")
_COLUMNS = ("Name", "Rows", "Bytes", "Cost (%CPU)", "Cost")
#: Bytes of files that are parsed together; a file is never cut.
BYTES_AT_ONCE = 4 << 20
_CELLS = ("id", "op", "name", "rows", "bytes", "cost")
#: A step's columns and the cell each is made of.
_OF = {"step_id": "id", "depth": "op", "operation": "op", "object_name": "name", "rows": "rows", "bytes": "bytes", "cost": "cost"}


def _first(found: list[str]) -> str | None:
    return max(found, key=lambda x: x.encode(), default=None)


@lru_cache(maxsize=256)
def _header(line: str) -> tuple[list[str], list[int | None], int] | None:
    """Names of a header line, where the wanted columns stand and where the operation; None if it names no operation. Listings repeat a few headers."""
    cells = [x.strip(" ") for x in line.split("|")]
    return (cells, _places(cells), cells.index("Operation")) if "Operation" in cells else None


def _places(names: list[str]) -> list[int | None]:
    """Where the wanted columns stand; of a repeated name the last."""
    at = dict(zip(names, range(len(names))))
    return [at.get(n) for n in _COLUMNS]


def _parse(plan: str) -> tuple:
    """(sql_id, plan_hash_value, sql_text, notes, steps as tuples of ``_CELLS``, predicates as tuples of step and text) of one plan's lines."""
    ids, hashes, body, notes, steps, said = [], [], [], [], [], []
    section, names, of, op, places, width = "", [], None, 0, [], 0
    for line in plan.split("\n"):
        if not line:
            continue
        bare = line.lstrip(" ") if line[0] == " " else line
        first = bare[:1]
        if first == "|":
            raw = bare.split("|")  # begins with what is before the first bar, in header and rows alike
            if "Operation" in bare and (head := _header(bare)):
                names, places, op = head
                width = len(names)
            elif names and ((cell := raw[1].strip(" ")).isdecimal() and cell.isascii() or _STEP.match(cell)):
                n = len(raw)
                at = places if n >= width else _places(names[:n])
                name, rows, size, cpu, cost = [None if i is None else raw[i].strip(" ") for i in at]
                steps.append((cell, raw[op] if op < n else None, name, rows, size, cost if cpu is None else cpu))
        elif "SQL_ID" in line and (m := _SQL_ID.match(line)):
            ids.append(m[1])
        if "Plan hash value" in line and (m := _HASH.search(line)):
            hashes.append(m[1])
        if first in _FIRST and (mark := _mark(bare)):
            section, of = mark, None
        elif section == "text":
            if line.strip(_BLANK).strip("-"):
                body.append(line.strip(" "))
        elif section == "note":
            if _NOTE.match(line):
                notes.append(m[1] if (m := _NOTED.match(line)) else "")
        elif section == "predicates" and bare and (first != "-" or line.strip("-")):
            m = _PREDICATE.match(line)
            if m and int(m[1]) < 1 << 31:
                of = int(m[1])
            if of is not None:
                said.append((of, (m[2] if m else line).strip(" ")))
    return _first(ids), _first(hashes), " ".join(body), "; ".join(notes), steps, said


def _mark(bare: str) -> str | None:
    """The section that a line without leading blanks opens."""
    if bare.startswith("SQL_ID"):
        return "text"
    if bare.startswith("Plan hash value"):
        return "table"
    if bare.startswith("Predicate Information"):
        return "predicates"
    return "note" if bare.rstrip(" ") == "Note" else None


def _cut(content: str) -> list[str]:
    """The plans of a file: pieces from one line that begins with ``SQL_ID`` to the next; what stands before the first is none."""
    content = content.replace("\r\n", "\n")
    starts, at = [], content.find("SQL_ID")
    while at >= 0:
        line = content.rfind("\n", 0, at) + 1
        if not content[line:at].strip(" "):
            starts.append(line)
        at = content.find("SQL_ID", at + 6)
    return [content[a:b] for a, b in zip(starts, [*starts[1:], None])]


class _Lines:
    """The lines of a batch of files as one array, with numbers beside: the file of a line, the line that begins its plan (-1 before the first) and the
    heading above it. What holds for the lines behind is carried by a running maximum of line numbers."""

    def __init__(self, content: pa.Array):
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(content, ""), "\r\n", "\n"), "\n")
        self.lines = split.flatten()
        self.bare = pc.ascii_ltrim(self.lines, " ")
        ends = np.asarray(split.offsets)
        self.file = np.repeat(np.arange(len(split)), np.diff(ends))
        begins = self.starting("SQL_ID")
        self.plan = self.last(begins)
        self.plan[self.plan < ends[self.file] - ends[0]] = -1
        count = np.cumsum(begins)
        self.plan_no = count - (count - begins)[ends[self.file] - ends[0]]

    def starting(self, text: str) -> np.ndarray:
        return np.asarray(pc.starts_with(self.bare, text))

    def last(self, mark: np.ndarray) -> np.ndarray:
        """For each line the last marked line so far, -1 without one."""
        return np.maximum.accumulate(np.where(mark, np.arange(len(mark)), -1)) if len(mark) else np.empty(0, "int64")

    def found(self, plans: np.ndarray, mark: np.ndarray | bool, text: str, pattern: str) -> pa.Array:
        """For each plan the greatest of what the pattern (RE2, its group ``x``) finds in marked lines that hold the text."""
        at = np.flatnonzero(mark & (self.plan >= 0) & np.asarray(pc.match_substring(self.lines, text)))
        got = pc.struct_field(pc.extract_regex(self.lines.take(pa.array(at)), pattern), "x")
        of = self.plan[at][np.asarray(pc.is_valid(got))]
        got = got.drop_null()
        if (np.diff(of) <= 0).any():
            order = np.asarray(pc.sort_indices(pa.table([pa.array(of), got], ["plan", "x"]), [("plan", "ascending"), ("x", "ascending")]))
            order = order[np.diff(of[order], append=-1) != 0]
            of, got = of[order], got.take(pa.array(order))
        i = np.searchsorted(of, plans)
        return got.take(pa.array(i, mask=np.append(of, -1)[i] != plans))

    def predicates(self) -> dict[int, dict[int, list[str]]]:
        """By plan and step the pieces of text in its predicate sections."""
        here = self.starting("Predicate Information")
        headings = here | self.starting("SQL_ID") | self.starting("Plan hash value") | np.asarray(pc.equal(pc.ascii_rtrim(self.bare, " "), "Note"))
        above = self.last(headings)
        inside = (above >= 0) & here[above] & ~headings & (self.plan >= 0) & np.asarray(pc.not_equal(pc.ascii_trim(self.lines, "-"), ""))
        at = np.flatnonzero(inside & np.asarray(pc.not_equal(self.bare, "")))
        out: dict[int, dict[int, list[str]]] = {}
        of = heading = None
        for plan, under, line in zip(self.plan[at].tolist(), above[at].tolist(), self.lines.take(at).to_pylist(), strict=True):
            if under != heading:
                of, heading = None, under
            m = _PREDICATE.match(line)
            if m and int(m[1]) < 1 << 31:
                of = int(m[1])
            if of is not None:
                out.setdefault(plan, {}).setdefault(of, []).append((m[2] if m else line).strip(" "))
        return out

    def steps(self) -> tuple[np.ndarray, dict[str, Callable[[], pa.Array]]]:
        """The line numbers of all steps, and by name (``_CELLS``) how to get their cells."""
        table = self.starting("|") & (self.plan >= 0)
        named = np.flatnonzero(table & np.asarray(pc.match_substring(self.bare, "Operation")))
        texts = self.bare.take(named).dictionary_encode()
        heads = [_header(x) for x in texts.dictionary.to_pylist()]
        kind = np.full(len(table), -1)
        kind[named] = np.array([-1 if h is None else i for i, h in enumerate(heads)], "int64")[np.asarray(texts.indices)] if len(named) else -1
        head = self.last(kind >= 0)
        at = np.flatnonzero(table & (kind < 0) & (head >= self.plan) & (head >= 0))
        raw = pc.split_pattern(self.bare.take(at), "|")  # begins with what is before the first bar, in header and rows alike
        first = pc.ascii_trim(raw.flatten().take(np.asarray(raw.offsets)[:-1] + 1), " ")
        numbered = np.asarray(pc.match_substring_regex(first, r"^\*?[\t\n\x0b\f\r ]*[0-9]+[\t\n\x0b\f\r ]?\z"))
        at, cells, starts, n = at[numbered], raw.flatten(), np.asarray(raw.offsets)[:-1][numbered], np.diff(np.asarray(raw.offsets))[numbered]
        kinds = kind[head[at]]
        places = np.full((len(_COLUMNS) + 1, len(at)), -1)
        for k in np.unique(kinds):
            names, _, op = heads[k]
            width = np.minimum(n, len(names))
            for w in np.unique(width[kinds == k]):
                own = (kinds == k) & (width == w)
                for c, i in enumerate([*_places(names[:w]), op if op < w else None]):
                    places[c, own] = -1 if i is None else i

        def cell(c: int) -> pa.Array:
            return cells.take(pa.array(starts + places[c], mask=places[c] < 0))

        trimmed = lambda c: pc.ascii_trim(cell(c), " ")
        of = {"id": lambda: first.filter(numbered), "op": lambda: cell(5), "name": lambda: trimmed(0), "rows": lambda: trimmed(1), "bytes": lambda: trimmed(2)}
        return at, of | {"cost": lambda: pc.coalesce(trimmed(3), trimmed(4))}


def _number(cell: pa.Array) -> pa.Array:
    """The digits a cell begins with, as ``try_cast`` to double takes them."""
    digits = pc.struct_field(pc.extract_regex(cell, "^(?P<n>[0-9]+)"), "n")
    if (pc.max(pc.binary_length(digits)).as_py() or 0) > 300:  # beyond the largest double there is infinity
        return pa.array([None if d is None else float(d) for d in digits.to_pylist()], pa.float64())
    return digits.cast(pa.float64())


def _size(cell: pa.Array, compat: bool) -> pa.Array:
    """``plan_size`` (F7) of trimmed cells."""
    if compat:
        return _number(cell)
    power = pc.index_in(pc.utf8_slice_codeunits(cell, -1), pa.array([*"KkMmGg"]))
    return pc.multiply(_number(cell), pc.take(pa.array([1e3, 1e3, 1e6, 1e6, 1e9, 1e9, 1.0]), pc.fill_null(power, 6)))


def _step_values(cell: dict[str, Callable[[], pa.Array]], compat: bool) -> dict[str, Callable[[], pa.Array]]:
    """How to get a step's columns from its cells, as ``_typed`` has them; with ``compat`` the cost is left as text."""

    def step_id() -> pa.Array:
        digits = pc.ascii_ltrim(pc.ascii_trim(cell["id"](), "* \t\n\x0b\f\r"), "0")
        n = pc.if_else(pc.less_equal(pc.binary_length(digits), 10), pc.if_else(pc.equal(digits, ""), "0", digits), None).cast(pa.int64())
        return pc.if_else(pc.less(n, 1 << 31), n, None).cast(pa.int32())

    def depth() -> pa.Array:
        op = pc.ascii_rtrim(cell["op"](), " ")
        n = pc.subtract(pc.subtract(pc.utf8_length(op), pc.utf8_length(pc.ascii_ltrim(op, " "))), 1)
        return pc.max_element_wise(pc.fill_null(n, 0), 0).cast(pa.int32())

    def cost() -> pa.Array:
        c = pc.ascii_trim(pc.replace_substring_regex(cell["cost"](), r"\([\t\n\x0b\f\r ]*[0-9]*[\t\n\x0b\f\r ]*\)", ""), " ")
        return c if compat else _size(c, compat)

    return {
        "step_id": step_id, "depth": depth, "operation": lambda: pc.ascii_trim(cell["op"](), " "),
        "object_name": lambda: pc.if_else(pc.equal(n := cell["name"](), ""), None, n),
        "rows": lambda: _size(cell["rows"](), compat), "bytes": lambda: _size(cell["bytes"](), compat), "cost": cost,
    }


def _steps_of(path: pa.Array, content: pa.Array, heads: Sequence[str], names: Sequence[str], compat: bool) -> pa.RecordBatch:
    """The plans of a few files that have steps: path, plan_no, the wanted of sql_id and plan_hash_value, and steps as a list of the named columns."""
    x = _Lines(content)
    at, cells = x.steps()
    plans, begins = np.unique(x.plan[at], return_index=True)
    made = {
        "sql_id": lambda: x.found(plans, ~x.starting("|"), "SQL_ID", _SQL_ID_OF),
        "plan_hash_value": lambda: x.found(plans, True, "Plan hash value", _HASH_OF),
    }

    def predicate() -> pa.Array:
        said = x.predicates()
        own = zip(x.plan[at].tolist(), cells["id"]().to_pylist(), strict=True)
        return pa.array([" ".join(t) if (s := said.get(p)) and (t := s.get(int(c.lstrip("*")))) else None for p, c in own], pa.string())

    value = _step_values(cells, compat) | {"predicate": predicate}
    steps = pa.StructArray.from_arrays([value[n]() for n in names], list(names))
    steps = pa.ListArray.from_arrays(pa.array([*begins.tolist(), len(at)], pa.int32()), steps)
    return pa.RecordBatch.from_arrays(
        [path.take(pa.array(x.file[plans])), pa.array(x.plan_no[plans], pa.int64()), *[made[n]() for n in heads], steps], ["path", "plan_no", *heads, "steps"]
    )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``BYTES_AT_ONCE`` of content."""
    for b in batches:
        share = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), "int64")) // BYTES_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def _typed(cell: Callable[[str], Column], compat: bool, wanted: Sequence[str]) -> list[Column]:
    op = cell("op")
    made = {
        "step_id": lambda: F.translate(cell("id"), "*", "").try_cast("int"),
        "depth": lambda: F.greatest(F.lit(0), F.length(F.rtrim(op)) - F.length(F.trim(op)) - 1),
        "operation": lambda: F.trim(op),
        "object_name": lambda: F.nullif(cell("name"), F.lit("")),
        "rows": lambda: plan_size(cell("rows"), compat),
        "bytes": lambda: plan_size(cell("bytes"), compat),
        "cost": lambda: plan_cost(cell("cost"), compat),
    }
    return [made[c]().alias(c) for c in made if c in wanted]


def plans(files: DataFrame, compat: bool = False) -> DataFrame:
    """One row a plan: path, plan_no, sql_id, plan_hash_value, sql_text, notes, steps (array) and predicates (array of step_id and text pieces)."""
    text = dict.fromkeys(("sql_id", "plan_hash_value", "sql_text", "notes"), pa.string())
    kinds = text | {
        "steps": pa.list_(pa.struct([(c, pa.string()) for c in _CELLS])), "predicates": pa.list_(pa.struct([("step_id", pa.int32()), ("t", pa.string())])),
    }
    cells = ",".join(f"{c}:string" for c in _CELLS)
    schema = ", ".join(f"{c} string" for c in text) + f", steps array<struct<{cells}>>, predicates array<struct<step_id:int,t:string>>"
    named = lambda p: (*p[:4], [dict(zip(_CELLS, s)) for s in p[4]], [{"step_id": n, "t": t} for n, t in p[5]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [(path, no, *named(_parse(p))) for path, c in zip(*(c.to_pylist() for c in batch.columns), strict=True) for no, p in enumerate(_cut(c or ""), 1)]
            columns = zip(*rows) if rows else [[]] * (2 + len(kinds))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), *kinds.values()), strict=True)], ["path", "plan_no", *kinds])

    d = files.select("path", "content").mapInArrow(run, f"path string, plan_no long, {schema}")
    return d.withColumn("steps", F.transform("steps", lambda s: F.struct(*_typed(lambda c: s[c], compat, tuple(_OF)))))


def plan_headers(plans: DataFrame) -> DataFrame:
    """(path, plan_no, sql_id, plan_hash_value, sql_text, notes) of every plan."""
    return plans.select("path", "plan_no", "sql_id", "plan_hash_value", "sql_text", "notes")


STEP_COLUMNS = ("plan_no", "sql_id", "plan_hash_value", *_OF, "predicate")


def _listed(files: DataFrame, wanted: Sequence[str], compat: bool) -> DataFrame:
    """One row a plan that has steps: path, plan_no, the wanted heads and ``steps``, an array of the other wanted columns."""
    heads = [c for c in wanted if c in ("sql_id", "plan_hash_value")]
    # A step has its number, wanted or not, so that the list has a field.
    names = [c for c in (*_OF, "predicate") if c in wanted] or ["step_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield _steps_of(b.column(0), b.column(1), heads, names, compat)

    kinds = {"step_id": "int", "depth": "int", "rows": "double", "bytes": "double", "cost": "string" if compat else "double"}
    steps = ", ".join(f"{c}:{kinds.get(c, 'string')}" for c in names)
    schema = ", ".join(["path string, plan_no long", *[f"{c} string" for c in heads], f"steps array<struct<{steps}>>"])
    return files.select("path", "content").mapInArrow(run, schema)


def plan_step_lists(files: DataFrame, columns: Sequence[str] = STEP_COLUMNS) -> DataFrame:
    """SRC11: one row a plan that has steps: path, the wanted of plan_no, sql_id and plan_hash_value, and ``steps``, an array of the other wanted columns of
    ``plan_steps``. Rows stay where they were read. For readers that hold a plan's steps together: what is shuffled, sorted and sent are plans."""
    return _listed(files, columns, False).select("path", *[c for c in STEP_COLUMNS[:3] if c in columns], "steps")


def plan_steps(files: DataFrame, compat: bool = False, columns: Sequence[str] = STEP_COLUMNS, dealt: bool = True) -> DataFrame:
    """SRC11: one row a step: path, plan_no, sql_id, plan_hash_value, step_id, depth, operation, object_name, rows, bytes, cost, predicate.

    A predicate's continued lines are joined with a blank. ``columns``: those wanted besides the path; only they leave the parser. Steps come dealt
    by path, so what groups them by file or plan needn't deal them again; without ``dealt`` they stay where they were read, for readers that make
    them fewer first."""
    wanted = [c for c in STEP_COLUMNS if c in columns]
    of_plan = [c for c in wanted if c in STEP_COLUMNS[:3]]
    d = _listed(files, wanted, compat).select("path", *of_plan, F.posexplode("steps").alias("no", "s"))
    d = d.select("path", *of_plan, *[F.col("s")[c].alias(c) for c in wanted if c not in of_plan])
    d = d.repartition("path") if dealt else d
    return d.withColumn("cost", F.col("cost").try_cast("double")) if compat and "cost" in wanted else d
