"""Benchmark decontamination: an FM-index per shard of training text, searched for every benchmark window.

A window is 10 consecutive words of an item, or all words of a shorter one. Windows, with the items that have them, are sent to the executors in
blocks of about ``BLOCK``: one pass over the training table for each block, almost always one; a pass adds its hits to those of the passes
before, row by row, so neither repeated nor missing ids matter, and nothing is shuffled. A task
takes its documents shard by shard (about ``SHARD`` bytes): words become vocabulary numbers, words outside the block's
vocabulary separate, and runs too short for the shortest window are left out, since no window can occur there. The runs are indexed,
phrases searched backwards through wavelet-tree ranks, occurrences located by sampled suffix positions, and the hit
words merged to spans.

Null or wordless texts have no words and no hits; a wordless item has no window. Repeated documents count each, repeated items once.
An item without an id has no name and is left out of the lists of items, but its words are hit. Extra columns are not read. Empty tables: nothing is hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .fm_index import FMIndex
from .scratch import Scratch

WORDS = 10
BLOCK = 500_000
SHARD = 4 << 20
_INSIDE = bt.table_of(b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)))
SPAN = ("word_start", "word_end", "byte_start", "byte_end")
SPANS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in SPAN]))
_ARROW_SPANS = pa.list_(pa.struct([(x, pa.int64()) for x in SPAN]))


def windows_of(items: DataFrame, id_column: str = "item_id", text_column: str = "text", width: int = WORDS) -> DataFrame:
    """(item, window) rows, distinct; a window is its words joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = bt.utf8(batch.column(1))
            low = bt.LOWER[data]
            start, end, first = bt.words(_INSIDE[low], off)
            raw = low.tobytes()
            for r, item in enumerate(batch.column(0).to_pylist()):
                w = [raw[a:b].decode() for a, b in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]], strict=True)]
                if w:
                    made = sorted({" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))})
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(made), pa.string()), pa.array(made, pa.string())], ["item", "window"]
                    )

    return items.select(
        F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")
    ).mapInArrow(run, "item string, window string").distinct()


class Phrases:
    """A block of windows as vocabulary numbers, ready to be searched in a shard, and the items of each window."""

    def __init__(self, windows: list[str], items: list[list[str]]):
        data, off = bt.utf8(pa.array(windows, pa.string()))
        start, end, first = bt.words(_INSIDE[data], off)
        self.hashes, number = np.unique(bt.span_hashes(data, start, end), return_inverse=True)
        self.lengths = np.diff(first)
        self.words = np.zeros((len(windows), int(self.lengths.max())), np.int32)
        self.words[np.repeat(np.arange(len(windows)), self.lengths), bt.ranges(self.lengths)] = number + 1
        self.symbols = len(self.hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.names = sorted({x for own in items for x in own})
        at = {x: k for k, x in enumerate(self.names)}
        self.item_of = np.fromiter((at[x] for own in items for x in own), np.int32)
        self.item_first = np.concatenate([[0], np.cumsum([len(own) for own in items])])

    def items(self, windows: np.ndarray) -> set[str]:
        found = [self.item_of[self.item_first[w] : self.item_first[w + 1]] for w in windows]
        return {self.names[k] for k in np.unique(np.concatenate(found))}

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word hash, 0 for others."""
        out = np.zeros(len(h), np.int64)
        near = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        ok = self.hashes[k] == h[near]
        out[near[ok]] = k[ok] + 1
        return out

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, window) of every occurrence within a row; ``first`` has the first word of each row."""
        known = words > 0
        a, b, _ = bt.words(known, first)
        long = b - a >= self.lengths.min()
        a, b = a[long], b[long]
        if not len(a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = b - a + 1  # each run and a separator
        place = np.repeat(a, n) + bt.ranges(n)
        text = words[np.minimum(place, len(words) - 1)].copy()
        text[np.cumsum(n) - 1] = 0
        index = FMIndex(text, self.symbols, int(self.lengths.max()))
        lo, hi = index.search(self.words, self.lengths)
        count = hi - lo
        window = np.repeat(np.arange(len(lo)), count)
        rows = np.repeat(lo, count) + bt.ranges(count)
        return place[index.locate(rows)], window


Finish = Callable[[pa.RecordBatch, np.ndarray, list[list[dict]], list[list[str]]], pa.RecordBatch]


def _scan(phrases_cast, text: int, earlier: tuple[int, int] | None, finish: Finish, shard: int):
    """Searches the text column; ``earlier``: the columns with the spans and items of the passes before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_cast.value
        for batch in batches:
            data, off = bt.utf8(batch.column(text))
            for i, j in bt.pieces(off, shard):
                part = batch.slice(i, j - i)
                numbers, starts, ends, firsts, base = [], [], [], [np.zeros(1, np.int64)], 0
                for p, q in bt.pieces(off[i : j + 1]):  # words in smaller steps, for the cache
                    low = bt.LOWER[data[off[i + p] : off[i + q]]]
                    s, e, f = bt.words(_INSIDE[low], off[i + p : i + q + 1] - off[i + p])
                    numbers.append(phrases.numbers(bt.span_hashes(low, s, e)))
                    starts.append(s + off[i + p])
                    ends.append(e + off[i + p])
                    firsts.append(f[1:] + base)
                    base += len(s)
                words, s, e, first = np.concatenate(numbers), np.concatenate(starts), np.concatenate(ends), np.concatenate(firsts)
                at, window = phrases.occurrences(words, first)
                to = at + phrases.lengths[window]
                items: list[set[str]] = [set() for _ in range(j - i)]
                row = np.searchsorted(first, at, "right") - 1
                pairs = np.unique(row * len(phrases.lengths) + window)
                own = np.searchsorted(pairs // len(phrases.lengths), np.arange(j - i + 1))
                for r in np.flatnonzero(np.diff(own)):
                    items[r] |= phrases.items(pairs[own[r] : own[r + 1]] % len(phrases.lengths))
                if earlier:
                    for r, (spans, named) in enumerate(
                        zip(part.column(earlier[0]).to_pylist(), part.column(earlier[1]).to_pylist(), strict=True)
                    ):
                        items[r].update(named)
                        if spans:
                            at = np.concatenate([at, [first[r] + x["word_start"] for x in spans]])
                            to = np.concatenate([to, [first[r] + x["word_end"] for x in spans]])
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, at, 1)
                np.add.at(change, to, -1)
                a, b, f = bt.words(np.cumsum(change[:-1]) > 0, first)
                spans = [[] for _ in range(j - i)]
                for r in np.flatnonzero(np.diff(f)):
                    o, w = off[i + r], first[r]
                    bounds = [(x - w, y - w, s[x] - o, e[y - 1] - o) for x, y in zip(a[f[r] : f[r + 1]], b[f[r] : f[r + 1]], strict=True)]
                    spans[r] = [dict(zip(SPAN, x, strict=True)) for x in bounds]
                yield finish(part, np.diff(first), spans, [sorted(x) for x in items])
        pa.default_memory_pool().release_unused()

    return run


def _search(docs: DataFrame, items: DataFrame, text_column: str, last: Finish, schema: T.StructType, block: int, shard: int) -> DataFrame:
    """``docs`` after a pass for each block of windows; the last pass ends with ``last`` and gives rows of ``schema``."""
    spark = docs.sparkSession
    wins = windows_of(items)
    blocks = max(1, -(-wins.select("window").distinct().count() // block))
    names = ["__spans", "__items"]
    while set(names) & set(docs.columns):
        names = [f"_{x}" for x in names]
    columns = len(docs.columns)
    between = T.StructType([*docs.schema.fields, T.StructField(names[0], SPANS), T.StructField(names[1], T.ArrayType(T.StringType()))])
    text, scratch, earlier = docs.columns.index(text_column), None, None

    header = between.names

    def add(part: pa.RecordBatch, n_words: np.ndarray, spans: list, named: list) -> pa.RecordBatch:
        kept = [part.column(k) for k in range(columns)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(spans, _ARROW_SPANS), pa.array(named, pa.list_(pa.string()))], header)

    for k in range(blocks):
        own = wins.where(
            F.pmod(F.xxhash64("window"), F.lit(blocks)) == k
        ).groupBy("window").agg(F.collect_set("item").alias("items")).toArrow()
        # No item has a word: an empty window finds nothing, and the words are counted all the same.
        phrases = Phrases(own["window"].to_pylist(), own["items"].to_pylist()) if own.num_rows else Phrases([""], [[]])
        cast = spark.sparkContext.broadcast(phrases)
        if k + 1 == blocks:
            return docs.mapInArrow(_scan(cast, text, earlier, last, shard), schema)
        scratch = scratch or Scratch(spark, "decontaminate")
        docs = scratch.table(docs.mapInArrow(_scan(cast, text, earlier, add, shard), between))
        cast.destroy()
        earlier = (len(between) - 2, len(between) - 1)
        scratch.drop_all(docs)
    raise AssertionError


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, shard: int = SHARD
) -> DataFrame:
    """(id, n_words, spans, items) of every row; ``items``: the ids of the items with a window in it, as sorted strings."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]

    def finish(part: pa.RecordBatch, n_words: np.ndarray, spans: list, named: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(named, pa.list_(pa.string()))],
            ["id", "n_words", "spans", "items"],
        )

    return _search(texts, items, "text", finish, T.StructType([texts.schema["id"], *fields]), block, shard)


def op10_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = contamination(docs, items)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["word_end"] - s["word_start"])
    out = found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    )
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _cut(at: int, columns: list[str]) -> Finish:
    def finish(part: pa.RecordBatch, n_words: np.ndarray, spans: list, named: list) -> pa.RecordBatch:
        texts, keep = part.column(at).to_pylist(), np.ones(part.num_rows, bool)
        for r, own in enumerate(spans):
            if own:
                raw, out, p = texts[r].encode(), [], 0
                for s in own:
                    out.append(raw[p : s["byte_start"]])
                    p = s["byte_end"]
                rest = b"".join([*out, raw[p:]])
                texts[r], keep[r] = rest.decode(), bool(_INSIDE[bt.LOWER[np.frombuffer(rest, np.uint8)]].any())
        kept = [pa.array(texts, part.schema.field(k).type) if k == at else part.column(k) for k in range(len(columns))]
        return pa.RecordBatch.from_arrays(kept, columns).filter(pa.array(keep))

    return finish


def remove_hits(docs: DataFrame, items: DataFrame, text_column: str = "text", block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The documents with hit passages cut out (from the first byte of the first hit word to the last byte of the last);
    documents of which no word remains go. Documents without hits stay as they are; the columns stay, ``n_chars`` follows the text."""
    columns, schema = docs.columns, docs.schema
    out = _search(docs, items, text_column, _cut(columns.index(text_column), columns), schema, block, shard)
    return out.withColumn(
        "n_chars", F.coalesce(F.char_length(text_column), F.col("n_chars")).cast(schema["n_chars"].dataType)
    ) if "n_chars" in columns else out


#: Exact counterpart in DuckDB SQL: windows as strings, joined with every run of as many words of a document.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda i:
  array_to_string(ws[i:i + 9], ' '))) AS win FROM b WHERE len(ws) > 0),
k AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, k WHERE len(ws) >= n),
o AS (SELECT g.doc_id, g.i, g.n, w.item_id FROM g JOIN w ON w.n = g.n AND array_to_string(g.ws[g.i:g.i + g.n - 1], ' ') = w.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
