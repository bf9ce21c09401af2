"""MinHash near-duplicate detection over whole tables.

1. One Arrow pass makes, per document, the set of hashed word shingles, ``BANDS * ROWS`` universal hash minima, one key for
   each band, and a short signature (a byte of every minimum).
2. Documents with equal sets form a class; the smallest id stands for it.
3. Class representatives that share a band key become candidates: each with the smallest of its bucket. Signatures drop hopeless
   pairs; the others are verified on the full sets of the whole texts, grouped by the smaller document in blocks of
   ``BLOCK``, so a hot document's partners spread over many tasks.
4. Connected components of the verified links.
5. Buckets whose members still lie in different components are searched again, across components only: all such pairs in buckets of up to
   ``SMALL`` members; in larger ones a leader drawn anew each turn, with the members of other components. These turns are cheap and join
   most of what belongs together; a turn that finds hardly any link is the last.
6. Members of large buckets that are mixed even then are searched by exact prefixes. Shingles are ordered from rare to frequent; two sets of which
   3/4 of the union is common share one of the first n/4 + 1 of the larger and n/7 + 1 of the smaller set. So an equality join on these finds every
   pair; sizes and places in the order drop most others before the full sets are compared. Any fixed order is right, so counts by slot of a
   hash, of fixed size, will do. A template that all pages share stands last in the order and makes no pairs.

Words are compared as 64-bit hashes. A pair of similarity 0.75 meets in no band with a probability of
(1 - 0.75**4)**32 = 5e-6. Every reported link is exact, and every pair that shares a band is compared, already in one component or shown to be
less alike by step 6.

Null or wordless texts are linked with nothing; texts of fewer than five words are one shingle. Equal rows and ties resolve to the
smallest id. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext as bt
from .components import components
from .scratch import Scratch
from .spread import spread_join

WORDS = 5
ROWS, BANDS = 4, 32
SMALL, BLOCK = 16, 256
#: Step 6 counts shingles in 2 ** SLOT_BITS slots (2 MB to every executor, whatever the input) and deals a shingle's rows to pieces of about PIECE.
SLOT_BITS, PIECE = 18, 4096
#: A turn of step 5 is the last if fewer than one in FEW of its pairs are links.
FEW = 16
_SPACE = bt.table_of(bytes([0x20, *range(0x09, 0x0E)]))
U64 = np.uint64


def _parameters(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.arange(1, 2 * n + 1, dtype=U64)
    with np.errstate(over="ignore"):
        made = bt.mix(seeds * U64(0x9E3779B97F4A7C15))
    return made[:n] | U64(1), made[n:]


_A, _B = _parameters(ROWS * BANDS)


def shingle_rows(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, with repeats, and the first shingle of each row."""
    start, end, first = bt.words(~_SPACE[data], offsets)
    h = bt.span_hashes(bt.LOWER[data], start, end)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.repeat(first[:-1], n) + bt.ranges(n)
    length = np.repeat(np.minimum(count, width), n)
    out = length.astype(U64)
    for k in range(width):
        w = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else h
        out = np.where(k < length, out * U64(0xD1342543DE82EF95) + w, out)
    return bt.mix(out), np.concatenate([[0], np.cumsum(n)])


def distinct_rows(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the first of each row."""
    out, sizes = values.copy(), np.zeros(len(first) - 1, np.int64)
    keep = np.zeros(len(values), bool)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b > a:
            out[a:b].sort()
            keep[a] = True
            np.not_equal(out[a + 1 : b], out[a : b - 1], out=keep[a + 1 : b])
            sizes[i] = keep[a:b].sum()
    return out[keep], np.concatenate([[0], np.cumsum(sizes)])


def _minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over each row; rows must not be empty."""
    out = np.empty((len(first) - 1, ROWS * BANDS), U64)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat(values * _A[k] + _B[k], first[:-1])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_shingles", "set_a", "set_b", "signature", "bands"]
    for batch in batches:
        data, off = bt.utf8(batch.column(1))
        for i, j in bt.pieces(off):
            o = off[i : j + 1] - off[i]
            v, first = distinct_rows(*shingle_rows(data[off[i] : off[j]], o))
            size = np.diff(first)
            full = np.flatnonzero(size)
            sums = np.zeros((2, j - i), U64)
            sig: list[bytes | None] = [None] * (j - i)
            bands = np.zeros((len(full), BANDS), U64)
            if len(full):
                begin = first[:-1][full]
                sums[0, full] = np.add.reduceat(bt.mix(v + U64(1)), begin)
                sums[1, full] = np.add.reduceat(bt.mix(v ^ U64(0x5851F42D4C957F2D)), begin)
                m = _minima(v, np.append(begin, len(v)))
                for k, row in zip(full, (m >> U64(32)).astype(np.uint8), strict=True):
                    sig[k] = row.tobytes()
                for k in range(BANDS):
                    key = np.full(len(full), k + 1, U64)
                    for r in range(ROWS):
                        key = bt.mix(key * U64(0xD1342543DE82EF95) + m[:, k * ROWS + r])
                    bands[:, k] = key
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)), pa.array(bands.ravel().view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i),
                    pa.array(size),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array(sig, pa.binary()),
                    lists,
                ],
                names,
            )


def _similar_signatures(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            same = (a == b).mean(axis=1)
            ok = pa.array((same - 1 / 256) / (1 - 1 / 256) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(ok) for k in (0, 1, 4)], ["a", "b", "n"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets have ``threshold`` percent of their union in common."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < threshold * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _verify(threshold: int):
    """Rows come sorted by (a, block, not the leader): the leader's set is kept while its block passes (several sets if rows repeat its id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lead_sets = None, []
        for batch in batches:
            data, off = bt.utf8(batch.column(4))
            a, block, b, leads = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            hit = []
            for i, j in bt.pieces(off):
                v, first = distinct_rows(*shingle_rows(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                for k in range(i, j):
                    own = v[first[k - i] : first[k - i + 1]]
                    if leads[k]:
                        lead_sets = [*lead_sets, own] if held == (a[k], block[k]) else [own]
                        held = (a[k], block[k])
                        continue
                    assert held == (a[k], block[k])
                    if any(_alike(lead, own, threshold) for lead in lead_sets):
                        hit.append(k)
            if hit:
                yield pa.RecordBatch.from_arrays([pa.array(a[hit], pa.int64()), pa.array(b[hit], pa.int64())], ["u", "v"])

    return run


def _confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: int, scratch: Scratch, many: bool = False) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough, as edges (u, v). ``n`` is the size of the largest bucket that a
    pair shares; by it a's partners are dealt to blocks.

    What is to be read together is written first: where that is little, its known size lets Spark broadcast it and leave the texts in place;
    ``many`` says that it grows with the table and is to be merged."""
    sig = sketches.select("id", "signature")
    near = scratch.table(
        pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b", "n")
        .mapInArrow(_similar_signatures(threshold / 100 - 0.2), "a long, b long, n long")
    )
    block = F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).cast("int")
    members = near.select("a", block.alias("block"), "b", F.lit(0).alias("leads"))
    leaders = members.select("a", "block", F.col("a").alias("b"), F.lit(1).alias("leads")).distinct()
    wanted = scratch.table(members.union(leaders))
    rows = (wanted.hint("merge") if many else wanted).join(texts.toDF("b", "text"), "b").select("a", "block", "b", "leads", "text")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "a", "block").sortWithinPartitions("a", "block", F.desc("leads"), "b").mapInArrow(
        _verify(threshold), "u long, v long"
    )


def _cross_pairs(rows: DataFrame, seed: int, total: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a < b) of different components that share a key. ``rows``: key, id, component.

    Up to SMALL members: all such pairs. Beyond: a leader drawn anew by every seed, with the members of other components."""
    size = rows.groupBy("key").agg(
        F.count("*").alias("n"),
        F.min("component").alias("lo"),
        F.max("component").alias("hi"),
        F.min_by(F.struct("id", "component"), F.xxhash64("id", "key", F.lit(seed))).alias("lead"),
    ).where("lo <> hi")
    size = scratch.table(size.select("key", "n", F.col("lead.id").alias("lead"), F.col("lead.component").alias("lead_component")))
    met = spread_join(rows, size, ["key"], "n", total).where((F.col("n") <= SMALL) | (F.col("component") != F.col("lead_component")))
    held = scratch.table(met.select("key", "id", "component", "n", "lead"))
    few = held.where(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("id", "component")).alias("m"))
    x = few.select("m", F.explode("m").alias("x")).select("x", F.explode("m").alias("y")).where(
        "x.id < y.id and x.component <> y.component"
    ).select(
        F.col("x.id").alias("a"), F.col("y.id").alias("b")
    )
    large = held.where(F.col("n") > SMALL).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"), "n")
    return x.select("a", "b", F.lit(SMALL).cast("long").alias("n")).union(large).groupBy("a", "b").agg(F.max("n").alias("n"))


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


def _slots(values: np.ndarray) -> np.ndarray:
    return (values >> U64(64 - SLOT_BITS)).astype(np.int64)


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents' shingles fall in each of 2 ** SLOT_BITS slots."""
    total = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        data, off = bt.utf8(batch.column(0))
        for i, j in bt.pieces(off):
            v, _ = distinct_rows(*shingle_rows(data[off[i] : off[j]], off[i : j + 1] - off[i]))
            total += np.bincount(_slots(v), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])


def _prefixes(counts_cast, threshold: int):
    """The rarest shingles of each document, by (count of the slot, hash): as many as a pair with a smaller or equal set can leave unshared,
    and one more. ``indexed``: those that a pair with a larger or equal set needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_cast.value
        for batch in batches:
            data, off = bt.utf8(batch.column(2))
            for i, j in bt.pieces(off):
                v, first = distinct_rows(*shingle_rows(data[off[i] : off[j]], off[i : j + 1] - off[i]))
                tokens, sizes = [v[:0]], np.zeros(j - i, np.int64)
                place, indexed = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
                for k in range(j - i):
                    own = v[first[k] : first[k + 1]]
                    n = len(own)
                    if n:
                        sizes[k] = n - _ceil(threshold * n, 100) + 1
                        at = np.arange(sizes[k])
                        tokens.append(own[np.lexsort((own, counts[_slots(own)]))[: sizes[k]]])
                        place.append(at)
                        indexed.append(at <= n - _ceil(2 * threshold * n, 100 + threshold))
                rows = np.repeat(np.arange(i, j), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        batch.column(0).take(pa.array(rows)),
                        batch.column(1).take(pa.array(rows)),
                        pa.array(np.repeat(np.diff(first), sizes)),
                        pa.array(np.concatenate(place)),
                        pa.array(np.concatenate(indexed)),
                    ],
                    ["token", "id", "component", "n", "place", "indexed"],
                )

    return run


def _prefix_pairs(rows: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a < b) of different components from ``rows`` of ``_prefixes``.

    Of a pair that is similar enough, the first common shingle is among x's prefix and among the indexed ones of y, y being the smaller set;
    what is left behind it in both bounds what they share. A shingle's rows are dealt to pieces of about PIECE."""
    tokens = rows.groupBy("token").agg(
        F.count("*").alias("members"), F.max("indexed").alias("any_indexed"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    tokens = scratch.table(tokens.where("any_indexed and lo < hi").select("token", "members"))
    held = scratch.table(spread_join(rows, tokens, ["token"], "members", rows.count()))
    pieces = F.ceil(F.col("members") / PIECE).cast("int")
    x = held.select("token", F.pmod(F.xxhash64("id"), pieces).cast("int").alias("piece"), "members", F.struct("id", "component", "n", "place").alias("x"))
    y = held.where("indexed").select(
        "token", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), F.struct("id", "component", "n", "place").alias("y")
    )
    smaller = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
    most = 1 + F.least(F.col("x.n") - 1 - F.col("x.place"), F.col("y.n") - 1 - F.col("y.place"))
    hopeful = (
        (F.col("x.component") != F.col("y.component"))
        & smaller
        & (F.col("y.n") * 100 >= F.col("x.n") * threshold)
        & (most * (100 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold)
    )
    return x.join(y, ["token", "piece"]).where(hopeful).groupBy(
        F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")
    ).agg(F.max("members").alias("n"))


def _links_of_mixed(rows: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: int, total: int, scratch: Scratch) -> DataFrame:
    """All links (u, v) between components among the members of large mixed buckets. ``rows``: key, id, component."""
    mixed = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = scratch.table(mixed.where((F.col("lo") < F.col("hi")) & (F.col("members") > SMALL)).select("key", "members"))
    held = scratch.table(spread_join(rows, mixed, ["key"], "members", total).select("id", "component").distinct())
    full = held.join(texts, "id").select("id", "component", "text")
    spark = texts.sparkSession
    found = full.select("text").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # one row a slot at most
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    cast = spark.sparkContext.broadcast(counts)
    kind = "token long, id long, component long, n long, place long, indexed boolean"
    pairs = scratch.table(_prefix_pairs(scratch.table(full.select("id", "component", "text").mapInArrow(_prefixes(cast, threshold), kind)), threshold, scratch))
    cast.destroy()
    return scratch.table(_confirm(pairs, sketches, texts, threshold, scratch))


def _join_components(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) after new links: only the components that the links join are solved anew."""
    ends = links.select(F.col("u").alias("id")).union(links.select("v")).distinct()
    known = scratch.table(found.union(ends.join(found, "id", "left_anti").select("id", "id")))
    of = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    joined = components(
        links.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct(), scratch
    )
    return scratch.table(
        known.join(joined.toDF("component", "new"), "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    )


def near_duplicates(docs: DataFrame, threshold: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; ids are whole numbers. Rows that repeat an id are one document: they get the smallest
    component of any of them."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketches = scratch.table(
        texts.mapInArrow(_sketch, "id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>")
    )
    sets = ["n_shingles", "set_a", "set_b"]
    with_words = sketches.where("n_shingles > 0 and id is not null")
    classes = scratch.table(with_words.groupBy(*sets).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    rows = sketches.count()
    members = spread_join(with_words, classes, sets, "copies", rows)
    reps = scratch.table(members.select("id", "rep", "signature", F.when(F.col("id") == F.col("rep"), F.col("bands")).alias("bands")))
    alone = reps.where("id = rep").select("id", "signature", "bands")
    banded, total = alone.select(F.explode("bands").alias("key"), "id"), rows * BANDS
    leads = scratch.table(banded.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    asked = scratch.table(
        spread_join(banded, leads, ["key"], "n", total).where("id <> a").groupBy("a", F.col("id").alias("b")).agg(F.max("n").alias("n"))
    )
    links = scratch.table(_confirm(asked, alone, texts, threshold, scratch, many=True))
    in_buckets = lambda: alone.join(found, "id", "left").select(
        F.explode("bands").alias("key"), "id", F.coalesce("component", "id").alias("component")
    )
    found, turn, more = scratch.table(components(links, scratch).toDF("id", "component")), 0, None
    while more is None or not more.isEmpty():
        if more is not None:
            found = _join_components(found, more, scratch)
        new = scratch.table(_cross_pairs(in_buckets(), turn, total, scratch).join(asked, ["a", "b"], "left_anti"))
        turn += 1
        if new.isEmpty():
            break
        asked = scratch.table(asked.union(new))
        more = scratch.table(_confirm(new, alone, texts, threshold, scratch))
        few = more.count() * FEW < new.count()
        scratch.drop_all(sketches, reps, found, asked, more)
        if few:  # hardly any of these pairs are links: what is left is for step 6
            found = _join_components(found, more, scratch) if not more.isEmpty() else found
            break
    rest = _links_of_mixed(in_buckets(), alone, texts, threshold, total, scratch)
    if not rest.isEmpty():
        found = _join_components(found, rest, scratch)
    owner = reps.join(found.toDF("rep", "component"), "rep", "left").groupBy("id").agg(
        F.min(F.coalesce("component", "rep")).alias("component")
    )
    out = sketches.select("id", "n_shingles").join(owner, "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
    scratch.drop_all(sketches, reps, found)
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op1_minhash_dedup(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


#: Exact counterpart for small tables: all pairs that share a shingle, and reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4],
  ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m
  LEFT JOIN n ON n.doc_id = m.doc_id
"""
