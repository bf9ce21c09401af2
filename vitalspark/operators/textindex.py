"""Substring search without a full scan (P5, P7): a posting table of trigrams names the texts that can hold a query; ``ilike`` confirms them.

Three Parquet tables under one path, all partitioned by ``load`` (what one call brought, so that a repeated call replaces its own rows):

* ``texts``: the texts with all their columns and a number, dealt by key to ``parts`` parts;
* ``postings``: every distinct trigram of a lower-cased text, as (gram, field, part, numbers of the texts): a row for each gram of some thousand texts, so
  that a gram is shuffled, sorted and written once for many texts. Dealt by gram to ``slots`` and sorted by gram;
* ``counts``: how many texts of a load hold a gram.

A query reads the counts of its own grams, the postings of the rarest few, and those parts of the texts that hold a candidate. All three are chosen
by partition values and pushed filters, so what is read follows what can match. Queries of fewer than three characters have no gram: all texts are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks import KeyedTable
from ..storage import exists
from .select import contains

#: So many of a query's grams, the rarest, are looked up in the postings.
GRAMS = 4


#: Characters whose trigrams are sorted together in a task; a longer text is taken alone.
AT_ONCE = 1 << 21
POSTINGS = "gram string, field int, part int, n int, texts array<bigint>"


def grams(text: Column) -> Column:
    """The distinct trigrams (of code points) of a lower-cased text, also those across its line feeds; NULL for NULL and short texts. For queries:
    the texts' own come from ``postings``."""
    low = F.lower(text)
    last = F.char_length(low) - 2
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(3)))))


def postings(texts: Sequence[str], part: np.ndarray, number: np.ndarray, field: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``POSTINGS`` for some lower-cased texts: each gram once for texts of one part that follow each other."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
    if len(codes) < 3:
        return
    seen = np.zeros(int(codes.max()) + 1, dtype=bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    base, many = len(alphabet), len(texts)
    if base**3 * many >= 1 << 63:  # a gram and a text must fit one number, which those of a single text always do
        half = many // 2
        yield from postings(texts[:half], part[:half], number[:half], field)
        yield from postings(texts[half:], part[half:], number[half:], field)
        return
    small = (np.cumsum(seen) - 1)[codes]
    of = np.repeat(np.arange(many), [len(t) for t in texts])
    whole = of[:-2] == of[2:]
    pairs = np.unique((((small[:-2] * base + small[1:-1]) * base + small[2:]) * many + of[:-2])[whole])
    if not len(pairs):
        return
    gram, text = np.divmod(pairs, many)
    first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[text[1:]] != part[text[:-1]])]))
    ends = np.append(first, len(pairs))
    g = gram[first]
    names = alphabet[np.stack([g // base**2, g // base % base, g % base], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([names[i : i + 3] for i in range(0, len(names), 3)], pa.string()),
            pa.array(np.full(len(g), field, dtype="int32")),
            pa.array(part[text[first]].astype("int32")),
            pa.array(np.diff(ends).astype("int32")),
            pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(number[text])),
        ],
        ["gram", "field", "part", "n", "texts"],
    )


def _postings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (part, text_no, lower-cased columns), ``AT_ONCE`` characters at a time."""
    for batch in batches:
        part, number = (batch.column(c).to_numpy() for c in (0, 1))
        for field in range(batch.num_columns - 2):
            texts = [t or "" for t in batch.column(field + 2).to_pylist()]
            begin = held = 0
            for i, t in enumerate(texts):
                if held and held + len(t) > AT_ONCE:
                    yield from postings(texts[begin:i], part[begin:i], number[begin:i], field)
                    begin, held = i, 0
                held += len(t)
            yield from postings(texts[begin:], part[begin:], number[begin:], field)


class TextIndex:
    """``keys`` name a text, ``columns`` are searched (a text matches if any of them holds the query). Both keep their types and names.

    Loads must not share keys, as after ``KeyedTable.insert_if_absent``: a key that two loads bring is found in both. Rows with NULL in a key
    are indexed like others."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], columns: Sequence[str], slots: int = 64, parts: int = 256):
        self.spark, self.path, self.keys, self.columns = spark, path, list(keys), list(columns)
        self.slots, self.parts = slots, parts

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int").alias("part")

    def _slot(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.slots)).cast("int")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, load: str, *by: str) -> None:
        d = df.withColumn("load", F.lit(load))
        d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", *by).parquet(f"{self.path}/{name}")

    def load(self, name: str, texts: DataFrame) -> None:
        """Adds the texts of a load, in place of those of an earlier try of the same name. An empty load changes nothing.

        The postings are made from the written texts, so a source is read once; counts come last and mark a load as complete."""
        dealt = texts.withColumn("part", self._part()).hint("rebalance", "part")
        self._write(dealt.withColumn("text_no", F.monotonically_increasing_id()), "texts", name, "part")
        if not exists(self.spark, f"{self.path}/texts/load={name}"):
            return
        own = self._table("texts").where(F.col("load") == name)
        rows = own.select("part", "text_no", *[F.lower(F.col(c)).alias(f"__{i}") for i, c in enumerate(self.columns)]).mapInArrow(_postings_of, POSTINGS)
        rows = rows.withColumn("slot", self._slot(F.col("gram"))).hint("rebalance", "slot").sortWithinPartitions("slot", "gram")
        self._write(rows, "postings", name, "slot")
        if not exists(self.spark, f"{self.path}/postings/load={name}"):  # no text of three characters
            return
        n = self._table("postings").where(F.col("load") == name).groupBy("slot", "gram").agg(F.sum("n").alias("n"))
        self._write(n.hint("rebalance", "slot").sortWithinPartitions("slot", "gram"), "counts", name, "slot")

    def _grams_of(self, query: str) -> list[tuple[str, int]]:
        """The query's grams and their slots; as many as the query has characters at most."""
        g = self.spark.range(1).select(F.explode(grams(F.lit(query))).alias("gram"))
        return [(r["gram"], r["slot"]) for r in g.select("gram", self._slot(F.col("gram")).alias("slot")).collect()]

    def rarest(self, query: str) -> list[tuple[str, int]] | None:
        """The (gram, slot) pairs to look up; empty if the query is too short for any, None if one of its grams is in no text."""
        own = self._grams_of(query)
        if not own:
            return []
        if not exists(self.spark, f"{self.path}/counts"):
            return None
        known = self._of(self._table("counts"), own).groupBy("gram", "slot").agg(F.sum("n").alias("n")).orderBy("n", "gram").collect()
        return [(r["gram"], r["slot"]) for r in known[:GRAMS]] if len(known) == len(own) else None

    def _of(self, table: DataFrame, wanted: Sequence[tuple[str, int]]) -> DataFrame:
        return table.where(F.col("slot").isin(*{s for _, s in wanted}) & F.col("gram").isin(*[g for g, _ in wanted]))

    def candidates(self, wanted: Sequence[tuple[str, int]]) -> DataFrame:
        """(load, part, text_no) of the texts that hold all the wanted grams in one column."""
        of = ["load", "part", "text_no"]
        each = self._of(self._table("postings"), wanted).select("load", "part", "field", "gram", F.explode("texts").alias("text_no"))
        both = each.groupBy(*of, "field").agg(F.count_distinct("gram").alias("n"))
        return both.where(F.col("n") == len(wanted)).select(*of).distinct()

    def search(self, query: str) -> DataFrame:
        """The rows whose text holds the query, without regard to case; ``%`` and ``_`` are plain characters."""
        holds = reduce(lambda a, b: a | b, [contains(F.col(c), query) for c in self.columns])
        wanted = self.rarest(query)
        if not wanted:
            whole = self._table("texts").where(holds if wanted is not None else F.lit(False))
            return whole.drop("load", "part", "text_no")
        found = self.candidates(wanted)
        texts = self.read_for(found)
        return texts.join(found, ["load", "part", "text_no"], "left_semi").where(holds).drop("load", "part", "text_no")

    def read_for(self, found: DataFrame) -> DataFrame:
        """The parts of the texts in which candidates lie; only these are read. Part numbers come to the driver, ``parts`` of them at most."""
        parts = [r["part"] for r in found.select("part").distinct().collect()]
        return self._table("texts").where(F.col("part").isin(*parts))


def index_step(index: TextIndex, table: KeyedTable, touched: Sequence[str]) -> Callable[[DataFrame], None]:
    """A step of the load chain (S3): indexes the rows of ``table`` with the touched keys.

    The load is named by the keys' hash, so a step that runs again replaces what it wrote before. A key belongs to one load as long as each
    snapshot is loaded once, as the chain's insert sees to."""
    of = list(touched)

    def run(keys: DataFrame) -> None:
        named = keys.select(*of).distinct()
        total = named.agg(F.count("*"), F.sum(F.xxhash64(*of).cast("decimal(38,0)"))).first()
        rows = table.read().join(named, of, "left_semi")
        index.load(f"{total[0]}_{total[1]}".replace("-", "m"), rows)

    return run
