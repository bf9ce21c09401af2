"""Exact removal of repeated byte strings over all documents, by suffix order and longest-previous-factor arrays.

A byte goes if a window of ``LENGTH`` bytes that covers it also starts earlier (smaller id, or earlier in the same text). Sorting every suffix of
the corpus together is out of reach, so the suffixes are dealt by content:

1. Each window has an anchor: the smallest hash among its ``GRAM``-byte strings (leftmost on ties). Equal windows have equal anchors at equal
   offsets. Consecutive windows with one anchor form a domain, about 35 windows; only domains are shuffled, as two hashes.
2. Domains whose anchor occurs once hold no repeated window. Of domains with equal content all but the first go whole, so copies are
   aggregated before anything else; anchors on many rows are dealt to several tasks.
3. Anchors with several different contents are left: one domain of each content (its first). Their bytes are dealt by anchor. Each task puts
   the suffixes that begin windows in suffix order to a depth of ``LENGTH`` bytes, finds for each the previous and the next entry of the order that
   start earlier in the corpus, and takes the longer of the common prefixes with these two as its longest previous factor (``longest_previous_factors``).
   A window goes if its factor has ``LENGTH`` bytes.
4. An anchor with more than ``GROUP`` contents is dealt anew: a window has 34 bytes before the anchor or 34 behind it, and goes by
   the anchor with those (``_second_anchors``); then as in 2 and 3. Where even such a group has more than ``GROUP`` contents (all alike in 66
   of at most 168 bytes), its windows' hashes are aggregated instead.

Nulls count as empty; texts under ``LENGTH`` bytes lose nothing. Rows that repeat an id with other texts are documents of their own, which follow each
other by the SHA-256 of their texts; rows that repeat id and text are one document and fare alike (``numbered``). Rows without an id are not
searched and lose nothing.
Extra columns are not read. Contents are compared by 128 bits of hash in step 2 (anchor and content) and at the end of 4, byte by byte in step 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .scratch import Scratch
from .spread import spread_join

LENGTH, GRAM = 100, 32
GROUP = 20_000
#: Every window has this many bytes before its anchor or behind it.
SIDE = (LENGTH - GRAM) // 2
#: Longest stretch handled at once; longer texts are cut into stretches that overlap by LENGTH - 1 bytes.
STRETCH = 8 << 20
U64 = np.uint64
_PLACE = U64((1 << 24) - 1)
with np.errstate(over="ignore"):
    _BYTE = bt.mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    _SECOND = bt.mix(np.arange(1, 257, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))


def gram_hashes(data: np.ndarray, width: int = GRAM, table: np.ndarray = _BYTE) -> np.ndarray:
    """Hash of every string of ``width`` bytes (any width), by doubling."""
    h, have, base = table[data], 1, 0xD1342543DE82EF95
    done, got = None, 0
    powers = base
    bits = width
    while bits:
        if bits & 1:
            if done is None:
                done, got = h[: len(data) - have + 1], have
            else:
                n = len(data) - got - have + 1
                done = done[:n] * U64(powers) + h[got : got + n]
                got += have
        bits >>= 1
        if bits:
            n = len(h) - have
            h = h[:n] * U64(powers) + h[have : have + n]
            powers = powers * powers & 0xFFFFFFFFFFFFFFFF
            have *= 2
    done = done ^ (done >> U64(32))
    done = done * U64(0xD6E8FEB86659FD93)
    return done ^ (done >> U64(29))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    out = x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def domains(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, row, first window, windows) of every domain; windows never cross rows. ``data`` has under 2**24 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(U64), none, none, none
    h = gram_hashes(data)
    low = sliding_minimum((h & ~_PLACE) | np.arange(len(h), dtype=U64), LENGTH - GRAM + 1) & _PLACE
    inside = np.ones(len(low), bool)  # windows that lie in one row
    edge = (offsets[1:-1, None] - np.arange(1, LENGTH)).ravel()
    inside[edge[(edge >= 0) & (edge < len(low))]] = False
    new = np.ones(len(low), bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[1:] |= ~inside[:-1]
    new &= inside
    at = np.flatnonzero(new)
    breaks = np.append(np.flatnonzero(new | ~inside), len(low))
    count = breaks[np.searchsorted(breaks, at) + 1] - at
    return h[low[at].astype(np.int64)], np.searchsorted(offsets, at, "right") - 1, at, count


def _stretches(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(first row, end row, bytes, offsets, shift): rows together, or a stretch of one long row that begins ``shift`` bytes in."""
    for i, j in bt.pieces(off):
        if off[j] - off[i] <= STRETCH:
            yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i], 0
            continue
        for a in range(0, int(off[j] - off[i]), STRETCH):
            part = data[off[i] + a : min(off[i] + a + STRETCH + LENGTH - 1, off[j])]
            yield i, j, part, np.array([0, len(part)]), a


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, off = bt.utf8(batch.column(1))
        for i, _, part, o, shift in _stretches(data, off):
            h, row, start, n = domains(part, o)
            if len(h):
                content = bt.span_hashes(part, start, start + n + LENGTH - 1)
                cols = [
                    h.view(np.int64), content.view(np.int64), ids[i + row], (start - o[row] + shift).astype(np.int32), n.astype(np.int32)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "content", "id", "start", "n"])


def _anchor_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = bt.utf8(batch.column(0))
        for _, _, part, o, _ in _stretches(data, off):
            yield pa.RecordBatch.from_arrays([pa.array(domains(part, o)[0].view(np.int64))], ["h"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns id, text, open (anchor, members, start, n): one row for each domain with its bytes."""
    for batch in batches:
        data, off = bt.utf8(batch.column(1))
        lists = batch.column(2)
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), counts)
        start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
        raw = [data[a : a + k + LENGTH - 1].tobytes() for a, k in zip(off[row] + start, n, strict=True)]
        ids = batch.column(0).take(pa.array(row))
        yield pa.RecordBatch.from_arrays(
            [flat.field("h"), flat.field("many"), ids, pa.array(start), pa.array(raw, pa.binary())], ["h", "many", "id", "start", "raw"]
        )


def _ranks(key: np.ndarray) -> np.ndarray:
    """Ranks of values, equal for equal values."""
    order = np.argsort(key)
    k = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[False], k[1:] != k[:-1]]))
    return out


def _tripled(rank: np.ndarray, width: int) -> np.ndarray:
    """Ranks of strings three times as long, from the ranks of strings of ``width`` bytes at every place."""
    n = len(rank) - 2 * width
    most = int(rank.max()) + 1
    key = rank[:n] * most + rank[width : width + n]
    if most**3 >= 1 << 62:
        key = _ranks(key)
    return _ranks(key * most + rank[2 * width :])


class Suffixes:
    """The suffixes at ``places`` of ``data``, each of LENGTH bytes at least, by their first LENGTH bytes.

    Strings of 8, 24 and 72 bytes are ranked at every place, each from the one before (prefix tripling); LENGTH bytes are two overlapping strings of 72."""

    WIDTHS = (72, 24, 8)

    def __init__(self, data: np.ndarray, places: np.ndarray):
        n = len(data) - 7
        self.word = np.zeros(n, U64)
        for k in range(8):
            self.word = (self.word << U64(8)) | data[k : k + n].astype(U64)
        self.ranks = {8: _ranks(self.word)}
        self.ranks[24] = _tripled(self.ranks[8], 8)
        self.ranks[72] = _tripled(self.ranks[24], 24)
        self.places = places

    def order(self) -> np.ndarray:
        """The suffix order, as numbers of ``places``; equal ones stay in the order given."""
        r = self.ranks[72]
        return np.argsort(r[self.places] * (int(r.max()) + 1) + r[self.places + LENGTH - 72], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b (numbers of ``places``), at most LENGTH."""
        a, b = self.places[a], self.places[b]
        have = np.zeros(len(a), np.int64)
        for width in (72, 24, 24, 24, 8, 8, 8):
            on = np.flatnonzero(have + width <= LENGTH)
            r = self.ranks[width]
            have[on] += width * (r[a[on] + have[on]] == r[b[on] + have[on]])
        at = np.minimum(have, LENGTH - 8)
        differ = self.word[a + at] ^ self.word[b + at]
        same = np.full(len(a), 8)
        for k in range(8):  # equal leading bytes
            same -= (differ >> U64(8 * k)) > 0
        return np.minimum(np.maximum(have, at + same), LENGTH)


def previous_smaller(x: np.ndarray, rounds: int = 64) -> np.ndarray:
    """For each entry of distinct numbers the nearest earlier one that is smaller, or -1: everything between the entry and its candidate is larger
    than the entry, so a larger candidate may be replaced by its own candidate. What many rounds leave open is walked with a stack."""
    near = np.arange(len(x)) - 1
    open_ = np.flatnonzero(x[near] > x) if len(x) else near
    open_ = open_[open_ > 0]
    for _ in range(rounds):
        if not len(open_):
            return near
        near[open_] = near[near[open_]]
        at = near[open_]
        open_ = open_[(at >= 0) & (x[at] > x[open_])]
    stack: list[int] = []
    for i, v in enumerate(x.tolist()):
        while stack and x[stack[-1]] > v:
            stack.pop()
        near[i] = stack[-1] if stack else -1
        stack.append(i)
    return near


def longest_previous_factors(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each place, given in text order, the longest prefix (at most LENGTH bytes) of its suffix that an earlier place's suffix begins with too.

    Among the earlier places the nearest ones in suffix order, before and behind, have the longest common prefixes."""
    if not len(places):
        return np.zeros(0, np.int64)
    suffixes = Suffixes(data, places)
    order = suffixes.order()
    before = previous_smaller(order)
    behind = len(order) - 1 - previous_smaller(order[::-1])[::-1]  # len(order) for none
    out = np.zeros(len(places), np.int64)
    for near in (before, behind):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        out[order[has]] = np.maximum(out[order[has]], suffixes.common(order[has], order[near[has]]))
    return out


def repeated_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For strings in text order: a flag for each window that also starts earlier (its longest previous factor has LENGTH bytes), and
    where each string's windows begin."""
    count = np.diff(offsets) - LENGTH + 1
    places = np.repeat(offsets[:-1], count) + bt.ranges(count)
    return longest_previous_factors(data, places) >= LENGTH, np.concatenate([[0], np.cumsum(count)])


def _resolve(batches: Iterator[pa.RecordBatch], together: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h; whole anchors at a time, about ``together`` bytes of them."""
    held: list[pa.RecordBatch] = []

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, start = t["id"].to_numpy(), t["start"].to_numpy()
        order = np.lexsort((start, ids))
        ids, start = ids[order], start[order]
        data, offsets = bt.utf8(t["raw"].combine_chunks().take(pa.array(order)))
        flags, first = repeated_windows(data, offsets)
        a, b, _ = bt.words(flags, first)
        if len(a):
            row = np.searchsorted(first, a, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array((start[row] + a - first[row]).astype(np.int32)), pa.array((b - a).astype(np.int32))],
                ["id", "start", "n"],
            )

    for batch in batches:
        held.append(batch)
        if sum(x.column(3).nbytes for x in held) > together:
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            change = np.flatnonzero(h[1:] != h[:-1])
            cut = int(change[-1]) + 1 if len(change) else 0  # the last anchor may go on
            if cut:
                yield from solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held:
        yield from solve(pa.Table.from_batches(held))


def _second_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits domains at their anchor: windows with SIDE bytes of it before the anchor's place, and those with SIDE bytes behind the anchor. The new
    key is the hash of these bytes and the anchor's; equal windows have equal keys."""
    for batch in batches:
        rows: list[tuple] = []
        for h, i, start, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            data = np.frombuffer(raw, np.uint8)
            at = int(np.argmax(gram_hashes(data).view(np.int64) == h))
            n = len(data) - LENGTH + 1
            cut = min(n, max(0, at - SIDE + 1))  # windows before it have SIDE bytes before the anchor
            for a, b, x in ((0, cut, at - SIDE), (cut, n, at)):
                if b > a:
                    rows.append((raw[x : x + GRAM + SIDE], raw[a : b + LENGTH - 1], i, start + a, b - a))
        if rows:
            keys, raws, ids, starts, sizes = zip(*rows, strict=True)
            hashed = [
                pa.array(bt.span_hashes(d, o[:-1], o[1:]).view(np.int64))
                for d, o in (bt.utf8(pa.array(x, pa.binary())) for x in (keys, raws))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    *hashed,
                    pa.array(ids, pa.int64()),
                    pa.array(starts, pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array(raws, pa.binary()),
                ],
                ["h", "content", "id", "start", "n", "raw"],
            )


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, start, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            data = np.frombuffer(raw, np.uint8)
            a, b = gram_hashes(data, LENGTH), gram_hashes(data, LENGTH, _SECOND)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)),
                    pa.array(np.full(len(a), i)),
                    pa.array((start + np.arange(len(a))).astype(np.int32)),
                ],
                ["a", "b", "id", "start"],
            )


WINDOWS = "id long, start int, n int"


def _resolved(rows: DataFrame) -> DataFrame:
    """Repeated windows among rows (h, id, start, raw), of which each h has at most GROUP."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(
        "h", "id", "start", "raw"
    ).repartition(parts, "h").sortWithinPartitions("h", "id", "start").mapInArrow(_resolve, WINDOWS)


def _of_frequent_anchors(heavy: DataFrame, group: int, scratch: Scratch) -> DataFrame:
    """Repeated windows of domains (h, many, id, start, raw) whose anchors have more than ``group`` contents."""
    halves = scratch.table(heavy.mapInArrow(_second_anchors, "h long, content long, id long, start int, n int, raw binary"))
    firsts = scratch.table(
        halves.groupBy("h", "content").agg(
            F.min(F.struct("id", "start", "raw")).alias("f"), F.count("*").alias("c")
        ).select("h", "content", "c", "f.*")
    )
    copies = firsts.where("c > 1").select("h", "content", "c", F.col("id").alias("first_id"), F.col("start").alias("first_start"))
    again = spread_join(
        halves.drop("raw"), copies, ["h", "content"], "c", halves.count()
    ).where("id <> first_id or start <> first_start").select("id", "start", "n")
    sizes = scratch.table(firsts.groupBy("h").agg(F.count("*").alias("many")).where("many > 1"))
    unsure = scratch.table(spread_join(firsts, sizes, ["h"], "many", firsts.count()))
    windows = unsure.where(F.col("many") > group).select("id", "start", "raw").mapInArrow(
        _window_hashes, "a long, b long, id long, start int"
    )
    kept = windows.groupBy("a", "b").agg(F.min(F.struct("id", "start")).alias("f")).select("f.id", "f.start")
    rest = windows.select("id", "start").join(kept, ["id", "start"], "left_anti").select("id", "start", F.lit(1).alias("n"))
    return again.union(_resolved(unsure.where(F.col("many") <= group))).union(rest)


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` (id, text) with ``no``, a number for each document, in order of ids and, where an id repeats, of the texts' SHA-256; null without an id.

    Where no id repeats, which one aggregate of ids tells, the id is the number. Else documents are sorted by range as (id, SHA-256) and numbered in place."""
    own = docs.withColumn("no", F.col("id").cast("long"))
    if own.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return own
    summed = docs.withColumn("sum", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = summed.where("id is not null").groupBy("id", "sum").agg(F.count("*").alias("c"))
    in_order = keys.repartitionByRange("id", "sum").sortWithinPartitions("id", "sum").withColumn("no", F.monotonically_increasing_id())
    found = spread_join(summed, scratch.table(in_order), ["id", "sum"], "c", docs.count(), "left")
    return found.select("id", "text", "no")


def repeated_spans(texts: DataFrame, group: int = GROUP, scratch: Scratch | None = None) -> DataFrame:
    """(id, windows): for every document with repeated windows, their runs as array<struct<start, n>>, offsets in bytes. ``texts``: id (long, no repeats
    and no nulls), text."""
    scratch = scratch or Scratch(texts.sparkSession, "suffix")
    kept = list(scratch.tables())
    anchors = texts.mapInArrow(_anchors, "h long, content long, id long, start int, n int")
    often = scratch.table(
        texts.select("text").mapInArrow(_anchor_hashes, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    )
    total = often.agg(F.sum("c")).first()[0] or 0
    shared = scratch.table(spread_join(anchors, often, ["h"], "c", total).drop("c"))
    first = scratch.table(shared.groupBy("h", "content").agg(F.min(F.struct("id", "start", "n")).alias("f")).select("h", "f.*"))
    various = scratch.table(first.groupBy("h").agg(F.count("*").alias("many")).where("many > 1"))
    unsure = scratch.table(spread_join(first, various, ["h"], "many", first.count()))
    # Whole domains: those of a document that are not the first of their content.
    marks = shared.select("id", "start", "n", F.lit(0).alias("is_first")).union(first.select("id", "start", "n", F.lit(1)))
    code = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("n").cast("long"))  # plain numbers, so that the difference of lists is by hashing
    lists = marks.groupBy("id").agg(
        F.collect_list(F.when(F.col("is_first") == 0, code)).alias("own"),
        F.collect_list(F.when(F.col("is_first") == 1, code)).alias("firsts"),
    )
    domain = lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("start"), c.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("n"))
    whole = scratch.table(
        lists.select("id", F.transform(F.array_except("own", "firsts"), domain).alias("windows")).where(F.size("windows") > 0)
    )
    scratch.drop_all(unsure, whole, *kept)
    asked = unsure.groupBy("id").agg(F.collect_list(F.struct("h", "many", "start", "n")).alias("open"))
    cut = scratch.table(texts.join(asked, "id").mapInArrow(_cut_out, "h long, many long, id long, start int, raw binary"))
    single = _resolved(cut.where(F.col("many") <= group))
    heavy = cut.where(F.col("many") > group)
    if not heavy.isEmpty():
        single = single.union(_of_frequent_anchors(heavy, group, scratch))
    some = single.groupBy("id").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    out = scratch.table(whole.union(some).groupBy("id").agg(F.flatten(F.collect_list("windows")).alias("windows")))
    scratch.drop_all(out, *kept)
    return out


def covered(rows: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs (row, start, end) that ranges cover in each row, joined where they touch."""
    if not len(rows):
        return rows, start, end
    wide = int(end.max()) + 2
    a, b = rows * wide + start, rows * wide + end
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    return a // wide, a % wide, b - (a // wide) * wide


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: removed byte runs, and the remaining bytes."""
    scratch = Scratch(docs.sparkSession, "suffix")
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    each = numbered(plain, scratch)
    searched = each.where("no is not null").select(F.col("no").alias("id"), "text")
    if scratch.tables():  # some id repeats: rows of one number are one document
        each = scratch.table(each)
        searched = scratch.table(each.where("no is not null").groupBy(F.col("no").alias("id")).agg(F.any_value("text").alias("text")))
    found = repeated_spans(searched, group, scratch).withColumnRenamed("id", "no")
    texts = each.join(found, "no", "left").select("id", "text", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bt.utf8(batch.column(1))
            raw = data.tobytes()
            windows = batch.column(2)
            own, flat = np.diff(
                np.concatenate([[0], np.cumsum(windows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            ), windows.flatten()
            start = flat.field("start").to_numpy().astype(np.int64)
            row, a, b = covered(np.repeat(np.arange(batch.num_rows), own), start, start + flat.field("n").to_numpy() + LENGTH - 1)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            kept = []
            for k in range(batch.num_rows):
                at, parts = int(off[k]), []
                for x, y in zip(a[first[k] : first[k + 1]], b[first[k] : first[k + 1]], strict=True):
                    parts.append(raw[at : off[k] + x])
                    at = off[k] + y
                kept.append(b"".join([*parts, raw[at : off[k + 1]]]))
            spans = pa.ListArray.from_arrays(
                pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), spans, pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"]
            )

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(
        run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    ).withColumnRenamed("id", id_column)


def op6_suffix_dedup(docs: DataFrame) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        gone.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
