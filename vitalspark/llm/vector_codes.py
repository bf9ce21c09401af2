"""Vector code compression: product quantisation whose later assignments are spared by norm-of-sum bounds.

Each vector becomes whole numbers floor(256 * x) and is cut into equal parts; every part has a codebook of entries and is written as the number
of its nearest entry. For each part and each group of entries a row keeps one lower bound: the distance to the nearest entry of the group (its
own entry aside) as it was measured in some round, with that round as the bound's stamp. All codebooks since the start are kept, so a
bound is carried to the present with the true net displacement of each entry between the stamp's codebook and the present one (the norm of the
sum of its moves, which is never more than the sum of their norms). Where the distance to a part's own entry, measured exactly, lies strictly
below a group's carried bound, no entry of that group can be nearest or tie; only the other groups are measured anew, and only they get a new
stamp. Comparisons leave room for rounding, and every decision between entries is made in whole numbers, so the codes are those of a full scan.

A round is one narrow pass over the rows, written as a table; every task adds the sums of its parts as one row more, and these are added up by
part and entry. The driver holds codebooks only: entries x components numbers a round, whatever the number of rows.

Defined cases. Dropped: rows whose vector is null, empty or holds null or non-finite components, and rows whose vector's length isn't that of
the first row (smallest id) whose length the number of parts divides. The starting entries are the first rows by id, then by vector;
rows without an id come last. Repeated rows and ids are rows of their own. With fewer rows than entries the codebooks have as many entries as
there are rows. Empty tables give no rows. Columns besides id, vector and label are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spread import spread_join

PARTS, ENTRIES, ROUNDS, GROUPS = 16, 64, 2, 4
#: Numbers in one block of differences while distances are measured.
BLOCK = 1 << 21
ROOM = 1e-9

FIRST_SQL = """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
rows_ AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, label, v FROM kept),
parts AS (
  SELECT r, p, list_slice(v, CAST(p * (len(v) // 16) + 1 AS BIGINT), CAST((p + 1) * (len(v) // 16) AS BIGINT)) AS w
  FROM rows_, range(16) AS t(p)),
b0 AS (SELECT p, r - 1 AS e, w AS c FROM parts WHERE r <= 64)"""


def _round_sql(k: int) -> str:
    return f"""a{k} AS (
  SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT x.r, x.p, b.e, CAST(list_sum(list_transform(list_zip(x.w, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts x JOIN b{k} b USING (p)) GROUP BY r, p)"""


def _update_sql(k: int) -> str:
    return f"""m{k} AS (
  SELECT p, e, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) - (CASE WHEN CAST(floor(CAST(s AS DOUBLE) / n) AS HUGEINT) * n > s THEN 1 ELSE 0 END)
    ORDER BY i) AS c
  FROM (SELECT a.p, a.best.e AS e, i, sum(w[i]) AS s, count(*) AS n FROM a{k} a JOIN parts x USING (r, p), range(1, 1 + len(w)) AS t(i) GROUP BY ALL)
  GROUP BY p, e),
b{k + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""


ORACLE_SQL = f"""WITH {FIRST_SQL}, {_round_sql(0)}, {_update_sql(0)}, {_round_sql(1)}, {_update_sql(1)}, {_round_sql(2)},
coded AS (SELECT r, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY r),
sha AS (
  SELECT sha256(string_agg(x, ',' ORDER BY p, e)) AS codebooks_sha256
  FROM (SELECT p, e, array_to_string(c, ',') AS x FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM rows_ JOIN coded USING (r), sha"""


@dataclass
class Codes:
    """``rows``: vec_id, label, code (hex), error, rescans (groups of entries measured again after the first round). ``codebooks``: whole numbers by
    part, entry and component."""

    rows: DataFrame
    codebooks: np.ndarray


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) as whole numbers: 64 bits, or Python's own where 64 bits could overflow in a squared distance."""
    if not len(values) or np.abs(values).max() < 1 << 16:
        return np.floor(values.astype(np.float64) * 256).astype(np.int64)
    return np.array([int(x) * 256 if abs(x) >= 1 << 53 else math.floor(x * 256) for x in values.astype(np.float64).tolist()], dtype=object)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows (n, width) to entries (m, width)."""
    return ((x[:, None, :] - entries[None]) ** 2).sum(-1)


def _below(squares: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit numbers that are never too large."""
    return np.nextafter(np.sqrt(squares.astype(np.float64)).astype(np.float32), np.float32(0))


def _groups(entries: int, groups: int) -> list[tuple[int, int]]:
    cuts = [entries * g // groups for g in range(groups + 1)]
    return list(zip(cuts, cuts[1:]))


class Assigner:
    """Assigns parts to the newest of the codebooks in ``history``."""

    def __init__(self, history: list[np.ndarray], groups: int):
        self.books, self.stamp = history[-1], len(history) - 1
        parts, entries, _ = self.books.shape
        self.groups = _groups(entries, min(groups, entries))
        moved = np.array([np.sqrt(((self.books - old) ** 2).sum(-1).astype(np.float64)) for old in history])  # net: stamp, part, entry
        self.moved = np.array([[[moved[t, p, a:b].max() for a, b in self.groups] for p in range(parts)] for t in range(len(history))])

    def first(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes, own squared distances, bounds of each group"""
        d = _squares(x, self.books[p])
        code = d.argmin(1)
        rows = np.arange(len(x))
        own = d[rows, code]
        far = np.sqrt(d.astype(np.float64))
        far[rows, code] = np.inf
        bounds = np.stack([np.nextafter(far[:, a:b].min(1).astype(np.float32), np.float32(0)) for a, b in self.groups], 1)
        return code, own, bounds

    def again(self, x: np.ndarray, p: int, code: np.ndarray, bounds: np.ndarray, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """codes, own squared distances, number of groups measured; ``bounds`` and ``stamps`` are changed in place."""
        own = ((x - self.books[p][code]) ** 2).sum(1)
        now = bounds.astype(np.float64) - self.moved[stamps, p, np.arange(len(self.groups))[None]]
        near = np.sqrt(own.astype(np.float64))
        opened = ~(near[:, None] * (1 + ROOM) + ROOM < now)
        best, least, measured = code.copy(), own.copy(), []
        for g, (a, b) in enumerate(self.groups):
            rows = np.flatnonzero(opened[:, g])
            if not len(rows):
                continue
            d = _squares(x[rows], self.books[p, a:b])
            k = d.argmin(1)
            found = d[np.arange(len(rows)), k]
            better = (found < least[rows]) | ((found == least[rows]) & (a + k < best[rows]))
            least[rows[better]], best[rows[better]] = found[better], a + k[better]
            measured.append((g, a, b, rows, d))
        for g, a, b, rows, d in measured:
            far = np.sqrt(d.astype(np.float64))
            inside = np.flatnonzero((best[rows] >= a) & (best[rows] < b))
            far[inside, best[rows[inside]] - a] = np.inf
            bounds[rows, g] = np.nextafter(far.min(1).astype(np.float32), np.float32(0))
            stamps[rows, g] = self.stamp
        left = np.searchsorted([b for _, b in self.groups], code, "right")  # the group of the entry that a row had
        rows = np.flatnonzero((best != code) & ~opened[np.arange(len(x)), left])
        bounds[rows, left[rows]] = np.minimum(_below(own[rows]), np.nextafter(now[rows, left[rows]].astype(np.float32), np.float32(-np.inf)))
        stamps[rows, left[rows]] = self.stamp
        return best, least, opened.sum(1)


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    n = len(column)
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(n, parts, -1)


def _state_schema(ids: pa.DataType, labels: pa.DataType, vectors: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("vec_id", ids), ("label", labels), ("vector", vectors), ("code", pa.binary()), ("bounds", pa.binary()), ("stamps", pa.binary()),
            ("rescans", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))
        ]
    )


def _pass(history: list[np.ndarray], groups: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round's work on a partition. Rows come with their state (from the second round on) and go with their new state, or with codes at last."""
    parts, entries, width = history[-1].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = Assigner(history, groups)
        n_groups = len(assign.groups)
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), history[-1].dtype)
        schema = None
        step = max(1, BLOCK // (entries * width))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(at, step)
                n = batch.num_rows
                x = _vectors(batch.column("vector"), parts)
                sums = sums if x.dtype == sums.dtype else sums.astype(object)
                codes, own = np.zeros((n, parts), np.int64), np.zeros((n, parts), x.dtype)
                if assign.stamp:
                    held = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t) for c, t in (("code", np.uint8), ("bounds", np.float32), ("stamps", np.uint8))]
                    before = held[0].reshape(n, parts).astype(np.int64)
                    bounds, stamps = (h.reshape(n, parts, n_groups).copy() for h in held[1:])
                    rescans = batch.column("rescans").to_numpy().copy()
                else:
                    bounds, stamps = np.zeros((n, parts, n_groups), np.float32), np.zeros((n, parts, n_groups), np.uint8)
                    rescans = np.zeros(n, np.int64)
                for p in range(parts):
                    if assign.stamp:
                        codes[:, p], own[:, p], again = assign.again(x[:, p], p, before[:, p], bounds[:, p], stamps[:, p])
                        rescans += again
                    else:
                        codes[:, p], own[:, p], bounds[:, p] = assign.first(x[:, p], p)
                    if not last:
                        np.add.at(counts[p], codes[:, p], 1)
                        np.add.at(sums[p], codes[:, p], x[:, p])
                raw = codes.astype(np.uint8)
                if last:
                    hexes = [r.tobytes().hex() for r in raw]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("vec_id"), batch.column("label"), pa.array(hexes, pa.string()), pa.array(own.sum(1).tolist(), pa.int64()), pa.array(rescans)],
                        ["vec_id", "label", "code", "error", "rescans"],
                    )
                    continue
                schema = schema or _state_schema(*[batch.schema.field(c).type for c in ("vec_id", "label", "vector")])
                binary = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (raw, bounds, stamps)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), batch.column("vector"), *binary, pa.array(rescans), pa.nulls(n, schema.field("sums").type)],
                    schema=schema,
                )
        if schema is not None:  # what this task adds to the next codebooks: for each part and entry its count, then its component sums
            flat = [int(v) for p in range(parts) for e in range(entries) for v in (counts[p, e], *sums[p, e])]
            row = [pa.nulls(1, f.type) for f in list(schema)[:-1]]
            yield pa.RecordBatch.from_arrays([*row, pa.array([flat], schema.field("sums").type)], schema=schema)

    return run


def _next_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries become the floor of their parts' mean; unused ones stay. What comes to the driver is one number a part, entry and component."""
    parts, entries, width = books.shape
    each = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").cast("decimal(38,0)").alias("x"))
    flat = np.zeros(parts * entries * (width + 1), object)
    for r in each.collect():
        flat[r["at"]] = int(r["x"])
    got = flat.reshape(parts, entries, width + 1)
    out = books.astype(object)
    for p in range(parts):
        for e in range(entries):
            if n := got[p, e, 0]:
                out[p, e] = [s // n for s in got[p, e, 1:]]
    return _narrow(out)


def _narrow(books: np.ndarray) -> np.ndarray:
    return books.astype(np.int64) if not books.size or max(abs(int(v)) for v in books.flat) < 1 << 24 else books


def compress(
    vectors: DataFrame, scratch: Scratch, id: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS
) -> Codes:
    """Learns codebooks in ``rounds`` rounds over all rows and codes every row. ``entries`` may be 256 at most, ``rounds`` 255."""
    if not (1 <= entries <= 256 and 0 <= rounds <= 255 and parts >= 1 and groups >= 1):
        raise ValueError("entries: 1 to 256, rounds: 0 to 255, parts and groups: 1 or more")
    kind = vectors.schema[vector].dataType
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    good = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(id).alias("vec_id"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).alias("vector")
    )
    order = F.struct(F.col("vec_id").isNull().alias("a"), F.col("vec_id").alias("b"), F.col("vector").alias("c"))
    fit = good.where(F.size("vector") % parts == 0)
    length = fit.agg(F.min_by(F.size("vector"), order).alias("n")).first()["n"]
    out_schema = f"vec_id {good.schema['vec_id'].dataType.simpleString()}, label {good.schema['label'].dataType.simpleString()}, code string, error long, rescans long"
    if length is None:
        return Codes(vectors.sparkSession.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64))
    good = good.where(F.size("vector") == length)
    seeds = good.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    seeds = np.stack([whole(np.array(r["vector"], np.float64)).astype(object) for r in seeds]).reshape(len(seeds), parts, -1)
    history = [_narrow(np.ascontiguousarray(seeds.transpose(1, 0, 2)))]
    state_schema = (
        f"vec_id {good.schema['vec_id'].dataType.simpleString()}, label {good.schema['label'].dataType.simpleString()}, vector {kind.simpleString()}, "
        "code binary, bounds binary, stamps binary, rescans long, sums array<decimal(38,0)>"
    )
    state = good
    for _ in range(rounds):
        rows = state.where("sums is null") if "sums" in state.columns else state
        new = scratch.table(rows.mapInArrow(_pass(history, groups, False), state_schema))
        if state is not good:
            scratch.drop(state)
        state = new
        history.append(_next_books(state, history[-1]))
    rows = state.where("sums is null") if "sums" in state.columns else state
    out = scratch.table(rows.mapInArrow(_pass(history, groups, True), out_schema))
    if state is not good:
        scratch.drop(state)
    return Codes(out, history[-1])


def decompress(codes: DataFrame, codebooks: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with ``approximation``, the vector that each code stands for (array<double>)."""
    parts, entries, _ = codebooks.shape
    book = F.array(*[F.array(*[F.lit(int(v) / 256) for v in codebooks[p, e]]) for p in range(parts) for e in range(entries)])
    number = lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.element_at(book, p * entries + number(p) + 1))))


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.flat).encode()).hexdigest()


def with_label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``, the sum of errors over equal labels; nulls are one label. A label of many rows is dealt to several tasks."""
    keyed = rows.withColumn("no_label", F.col("label").isNull()).withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit("")))
    each = keyed.groupBy("no_label", "key").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"), F.count("*").alias("of_label"))
    return spread_join(keyed, each, ["no_label", "key"], "of_label", rows.count()).drop("no_label", "key", "of_label")


def op11_vector_codes(vectors: DataFrame) -> DataFrame:
    scratch = Scratch(vectors.sparkSession, "op11")
    codes = compress(vectors, scratch)
    out = with_label_errors(codes.rows)
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(codes.codebooks)).alias("codebooks_sha256"))
