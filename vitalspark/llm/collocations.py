"""Phrase collocations by dynamic itemset counting.

The texts are dealt to a few shards, which are scanned in turn, round and round. One scan counts phrases of every length that is active. Single words
are active from the first shard; a longer phrase becomes active as soon as both phrases that it has but for one end word have reached the
threshold, in the midst of a cycle, and is counted until every shard has been seen once since it was first counted. So lengths overlap and a
corpus is scanned less than once for each length, and phrases with a rare part are never counted.

While shards are scanned, a phrase is a 64-bit hash of its lang and words: tasks sort hashes and count them, and rows of two numbers are added to the
counts so far in one shuffle and written as a table. Which phrases have reached the threshold is told to the tasks by two bit maps of fixed size for each
length (all, and those of the last cycle). A map may take a phrase for active that isn't: that costs work, not correctness, since any phrase that
is counted over one whole cycle has its full count. Bits are never taken back and the second map holds a phrase for one whole cycle, so no
counting ends early.

A phrase that stands ``least`` times stands more than ``(least - 1) // shards`` times in some shard. So a phrase is held from the first shard in which it
passes that number, with a bound for what earlier shards of its cycle may have had; the many rare phrases of a shard are never held. A phrase reaches
the threshold as soon as its count and that bound do. Phrases that share a hash are counted as one. All this can only raise counts: the phrases
found are all frequent ones and some others. A last scan reads the words of the phrases found and counts these exactly, by lang and words.

Defined cases. Null texts are empty; null langs are ``und``, together with a lang of that name. Ids are not looked at: repeated rows count as often as
they stand. Empty tables and texts without words give no rows. Columns besides text and lang are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import LOWER, U64, mix, ranges, slices, span_hashes, table_of, utf8, words
from .scratch import Scratch, shuffles_end_with_the_query
from .spread import spread_join

LEAST, LONGEST, TOP, INSIDE_PERCENT = 30, 4, 2000, 80
SHARDS = 3
#: Bits of one map; a power of two.
BITS = 1 << 23
#: Bytes of text that a task works on at once.
SLICE = 1 << 22
#: Phrases whose words are written out at once.
WRITTEN = 1 << 16

BREAKS = ".,;:!?\x0a\x0b\x0c\x0d"
_INSIDE = table_of(" \t" + BREAKS, False)
_BREAK = table_of(BREAKS)

_COUNTS = "k int, h long, n long"
_WORDS = "lang string, k int, phrase string, n long"
_ARROW = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def _sql_phrases(words: str, k: str) -> str:
    """SQL: every phrase of k words in a list of words, a row each."""
    return f"unnest(list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i:i + {k} - 1], ' ')))"


def _all(selects: list[str]) -> str:
    return " UNION ALL ".join(selects)


ORACLE_SQL = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS ({_all([f"SELECT lang, {k} AS k, phrase, count(*) AS a FROM (SELECT lang, {_sql_phrases('w', str(k))} AS phrase FROM w) GROUP BY ALL" for k in range(1, LONGEST + 1)])}),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= {LEAST}),
subs AS (SELECT lang, phrase, max(a) AS most FROM ({_all([f"SELECT lang, a, {_sql_phrases('w', str(k))} AS phrase FROM c WHERE k > {k}" for k in range(2, LONGEST)])}) GROUP BY ALL),
free AS (SELECT c.* FROM c LEFT JOIN subs s USING (lang, phrase) WHERE s.most IS NULL OR 100 * CAST(s.most AS HUGEINT) < {INSIDE_PERCENT} * CAST(c.a AS HUGEINT)),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS x, array_to_string(w[j + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM free)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, min(struct_pack(
    score := CAST((2000000 * CAST(cuts.a AS HUGEINT)) // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT), j := j, l := l.a, r := r.a)) AS best
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY best.score DESC, a DESC, encode(phrase)) AS rank FROM scored)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, best.l AS l, best.r AS r, n, best.score AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""


class Slice:
    """The words of some texts: which ones stand together in one piece, and running hashes of phrases."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = utf8(texts)
        self.data = data = LOWER[data]
        self.start, self.end, first = words(_INSIDE[data], offsets)
        self.n = n = len(self.start)
        doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        raw, off = utf8(coded.dictionary)
        lang_hash = span_hashes(raw, off[:-1], off[1:]) if len(raw) else np.zeros(len(self.langs), U64)
        #: Whether a word and the next one stand in the same piece.
        self.joined = np.zeros(n, bool)
        if n:
            self.lang = coded.indices.to_numpy()[doc]
            breaks = np.flatnonzero(_BREAK[data])
            piece = np.searchsorted(breaks, self.start)
            self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
            self.word = span_hashes(data, self.start, self.end)
            self.first = mix(self.word + mix(lang_hash + U64(1))[self.lang])

    def grams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For k = 1, 2, ...: k, for each word whether k words from there stand in one piece, and the hash of that phrase with its lang."""
        whole, h = np.ones(self.n, bool), self.first
        for k in range(1, longest + 1):
            yield k, whole, h
            if k < longest and self.n > k:
                whole = whole.copy()
                whole[:-k] &= self.joined[k - 1 : -1]
                whole[-k:] = False
                h = h.copy()
                h[:-k] = mix(h[:-k] * U64(0x9E3779B97F4A7C15) + self.word[k:])
            elif k < longest:
                return

    def written(self, k: int, at: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of lang, words and number for the phrases of k words that begin at ``at``: words with one blank between them."""
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        run = np.diff(np.append(first, len(h)))
        same = np.ones(len(at), bool)
        head = np.repeat(at[first], run)
        for j in range(k):
            same &= self.word[at + j] == self.word[head + j]
        same &= self.lang[at] == self.lang[head]  # equal hashes of unequal phrases: the odd ones get rows of their own
        one = np.concatenate([at[first], at[~same]])
        n = np.concatenate([run - np.add.reduceat((~same).astype(np.int64), first), np.ones(int((~same).sum()), np.int64)])
        for i in range(0, len(one), WRITTEN):
            some = one[i : i + WRITTEN]
            begin = (some[:, None] + np.arange(k)).reshape(-1)
            size = self.end[begin] - self.start[begin]
            room = size + np.tile(np.arange(k) < k - 1, len(some))  # a blank after each word but the last
            out = np.full(int(room.sum()), 32, np.uint8)
            to = np.cumsum(room) - room
            out[np.repeat(to, size) + ranges(size)] = self.data[np.repeat(self.start[begin], size) + ranges(size)]
            ends = (to + room)[k - 1 :: k]
            phrase = pa.Array.from_buffers(pa.large_string(), len(some), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(self.langs, pa.string()).take(pa.array(self.lang[some])), pa.array(np.full(len(some), k, np.int32)), phrase.cast(pa.string()),
                    pa.array(n[i : i + WRITTEN])
                ],
                schema=_ARROW,
            )

    def totals(self) -> pa.RecordBatch:
        """Words by lang, as phrases of no words."""
        size = len(self.langs)
        n = np.bincount(self.lang, minlength=size)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.langs, pa.string()), pa.array(np.zeros(size, np.int32)), pa.array([""] * size, pa.string()), pa.array(n)],
            schema=_ARROW,
        )


def _holds(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & U64(len(bits) * 64 - 1)
    return (bits[at >> U64(6)] >> (at & U64(63))) & U64(1) == 1


def _scan(singles: bool, maps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts one shard's active phrases by hash. ``maps``: a broadcast of {length: (reached, reached in the last cycle)}."""

    def counted(k: int, h: np.ndarray) -> pa.RecordBatch:
        found, n = np.unique(h, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found.view(np.int64)), pa.array(n)], ["k", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        longest = max([1, *[k + 1 for k in known]])
        for batch in slices(batches, 1, SLICE):
            some = Slice(batch.column(1), batch.column(0))
            if not some.n:
                continue
            before = None
            for k, whole, h in some.grams(longest):
                if k == 1 and singles:
                    yield counted(1, h)
                if k > 1 and k - 1 in known:
                    every, recent = (_holds(bits, before) for bits in known[k - 1])
                    active = whole[:-1] & every[:-1] & every[1:] & (recent[:-1] | recent[1:])
                    if active.any():
                        yield counted(k, h[:-1][active])
                before = h

    return run


def _read(maps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the phrases that the maps hold, and of all words by lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = maps.value
        for batch in slices(batches, 1, SLICE):
            some = Slice(batch.column(1), batch.column(0))
            if not some.n:
                continue
            yield some.totals()
            for k, whole, h in some.grams(max([1, *known])):
                if k in known:
                    at = np.flatnonzero(whole & _holds(known[k][0], h))
                    if len(at):
                        yield from some.written(k, at, h[at])

    return run


def _maps(state: DataFrame, lengths: list[int], step: int, shards: int, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bit maps of the phrases that reached the threshold. At most bits / 64 rows a length come to the driver, whatever the number of phrases."""
    bit = F.expr("shiftleft(1L, cast(h & 63L as int))")
    found = state.where(F.col("reach").isNotNull() & F.col("k").isin(lengths)).groupBy("k", F.expr(f"shiftrightunsigned(h & {bits - 1}L, 6)").alias("at")).agg(
        F.bit_or(bit).alias("every"), F.bit_or(F.when(F.col("reach") >= step - shards, bit).otherwise(F.lit(0).cast("long"))).alias("recent")
    )
    out = {k: (np.zeros(bits // 64, U64), np.zeros(bits // 64, U64)) for k in lengths}
    got = found.toArrow()
    k, at, every, recent = (got.column(c).to_numpy() for c in ("k", "at", "every", "recent"))
    for length, (a, b) in out.items():
        of = k == length
        a[at[of]], b[at[of]] = every[of].view(U64), recent[of].view(U64)
    return out


def phrase_counts(
    docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, shards: int = SHARDS,
    bits: int = BITS
) -> DataFrame:
    """Every phrase of up to ``longest`` words that stands at least ``least`` times in a lang: lang, k, phrase, n; and words in all, as k = 0."""
    spark = docs.sparkSession
    dealt = docs.select(
        F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int").alias("shard")
    )
    corpus = scratch.table(dealt, by="shard")
    state = spark.createDataFrame([], f"{_COUNTS}, start int, reach int")
    reached: dict[int, int] = {}  # the last step at which a phrase of so many words reached the threshold
    step = 0
    while step < shards or any(reached.get(k, -1 - shards) >= step - shards for k in range(1, longest)):
        lengths = [k for k in range(1, longest) if reached.get(k, -1 - shards) >= step - shards]
        maps = spark.sparkContext.broadcast(_maps(state, lengths, step, shards, bits) if lengths else {})
        counts = corpus.where(F.col("shard") == step % shards).select("lang", "text").mapInArrow(_scan(step < shards, maps), _COUNTS)
        new = scratch.table(_added(state, counts, step, shards, least))
        maps.destroy()
        if step:
            scratch.drop(state)
        state = new
        reached = {r["k"]: r["r"] for r in state.groupBy("k").agg(F.max("reach").alias("r")).collect() if r["r"] is not None}
        step += 1
    maps = spark.sparkContext.broadcast(_maps(state, list(range(1, longest + 1)), step, shards, bits))
    scratch.drop(state)
    counts = corpus.select("lang", "text").mapInArrow(_read(maps), _WORDS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    out = scratch.table(counts.where((F.col("k") == 0) | (F.col("n") >= least)))
    maps.destroy()
    scratch.drop(corpus)
    return out


def _added(state: DataFrame, counts: DataFrame, step: int, shards: int, least: int) -> DataFrame:
    """The counts so far with those of one more shard. Phrases that ended their cycle are not added to; those among them that didn't reach the
    threshold go, and so do phrases that are not held yet and are rare in this shard."""
    none = F.lit(None).cast("int")
    rare = (least - 1) // shards
    both = state.withColumn("new", F.lit(0).cast("long")).unionByName(
        counts.withColumns({"new": F.col("n"), "n": F.lit(0).cast("long"), "start": none, "reach": none})
    )
    summed = both.groupBy("k", "h").agg(F.sum("n").alias("n"), F.sum("new").alias("new"), F.max("start").alias("start"), F.max("reach").alias("reach"))
    summed = summed.where(F.col("start").isNotNull() | (F.col("new") > rare)).withColumn("start", F.coalesce("start", F.lit(step)))
    added = summed.withColumn("n", F.col("n") + F.when(F.col("start") + shards > step, F.col("new")).otherwise(0))
    missed = F.greatest(F.lit(0), F.least(F.lit(shards - 1), F.col("start") - F.col("k") + 1))  # shards of the cycle before the phrase was held
    reach = F.coalesce("reach", F.when(F.col("n") + rare * missed >= least, F.lit(step)))
    ends = F.col("start") + shards <= step + 1
    return added.select("k", "h", "n", "start", reach.alias("reach")).where(~ends | F.col("reach").isNotNull())


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(2000000 * a / (l + r)) in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * wide(a), wide(l) + wide(r))


def collocations(counts: DataFrame, scratch: Scratch, top: int = TOP, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """Ranks the phrases of two and more words in ``counts`` (see phrase_counts), best ``top`` of each lang."""
    phrases = counts.where("k > 0").select("lang", "k", "phrase", "n")
    found = phrases.where("k >= 2").withColumnRenamed("n", "a")
    subs = found.where("k > 2").select(
        "lang", "a",
        F.explode(
            F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
        ).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = found.join(subs, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * wide("most") < inside_percent * wide("a"))).drop("most")
    j = F.col("j")
    cuts = kept.withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "j",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), _part(F.lit(1), j).alias("part")), F.struct(F.lit(1).alias("side"), _part(j + 1, F.col("k") - j).alias("part")))).alias("s")
    ).select("lang", "phrase", "a", "j", "s.side", "s.part")
    cuts = scratch.table(cuts)
    uses = cuts.groupBy("lang", "part").agg(F.count("*").alias("uses"))
    known = phrases.select("lang", F.col("phrase").alias("part"), "n").join(uses, ["lang", "part"])
    sides = spread_join(cuts, known, ["lang", "part"], "uses", cuts.count()).groupBy("lang", "phrase", "a", "j").agg(
        F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r")
    )
    best = sides.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(docs: DataFrame) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "op13")
    with shuffles_end_with_the_query(docs.sparkSession):
        counts = phrase_counts(docs, scratch)
        return collocations(counts, scratch)
