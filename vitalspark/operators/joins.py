"""Joins beyond plain equality: tags, before/after, latest rows, time ranges, split OR conditions, greedy pairing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..storage import written


def range_blocks(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """Each closed range of whole numbers with the aligned blocks that it touches, as ``__shift`` and ``__block`` (number >> shift).

    A range's block is the smallest power of 4 beyond its length, so it touches at most two, however long it is; the longest (over 2^60) at most
    eight. Empty ranges and such without an end go."""
    d = ranges.where(F.col(first) <= F.col(last)).withColumns({"__a": F.col(first).cast("long"), "__z": F.col(last).cast("long")})
    bits = F.length(F.bin(F.try_subtract("__z", "__a")))
    d = d.withColumn("__shift", F.coalesce(F.least(F.lit(60), F.ceil(bits / 2).cast("int") * 2), F.lit(60)))
    block = F.explode(F.sequence(F.expr("shiftright(__a, __shift)"), F.expr("shiftright(__z, __shift)")))
    return d.withColumn("__block", block).drop("__a", "__z")


def range_join(points: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, first: str, last: str) -> DataFrame:
    """Points with every range that holds them (closed), as an equality join on keys and block plus a filter.

    ``at``, ``first`` and ``last`` are whole numbers. A range costs two rows at most (``range_blocks``), a point one for each size of block in use:
    ranges of like lengths share one. The sizes, 31 at most, are looked up first."""
    r = range_blocks(ranges, first, last)
    shifts = [x[0] for x in r.select("__shift").distinct().collect()]
    sizes = F.array(*map(F.lit, sorted(shifts))).cast("array<int>")
    p = points.withColumn("__shift", F.explode(sizes)).withColumn("__at", F.col(at).cast("long"))
    p = p.withColumn("__block", F.expr("shiftright(__at, __shift)")).drop("__at")
    return p.join(r, [*keys, "__shift", "__block"]).where(F.col(at).between(F.col(first), F.col(last))).drop("__shift", "__block")


def tag_join(facts: DataFrame, tags: DataFrame) -> DataFrame:
    """Facts in the snapshot intervals of tags (tag_name, tag_type, dbname, instance, snap_start, snap_end)."""
    return range_join(facts, tags, ["dbname", "instance"], "begin_snap", "snap_start", "snap_end")


def before_after(tagged: DataFrame, key: Sequence[str], value: Column, at_least: float = 0.0) -> DataFrame:
    """Mean before and after side by side with change; keys seen on one side only keep a 0 on the other. One aggregate in place of a
    full outer join: rows of both sides carry ``tag_type``."""
    side = lambda t: F.coalesce(F.avg(F.when(F.col("tag_type") == t, value)), F.lit(0.0))
    out = tagged.groupBy(*key).agg(side("before").alias("before_value"), side("after").alias("after_value"))
    out = out.where((F.col("before_value") >= at_least) | (F.col("after_value") >= at_least))
    return out.withColumn("delta", F.col("after_value") - F.col("before_value"))


def before_after_join(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """J6 as a full outer join of two aggregated sides with column ``value``."""
    j = before.withColumnRenamed("value", "b").join(after.withColumnRenamed("value", "a"), list(key), "full")
    return j.select(*key, F.coalesce("b", F.lit(0.0)).alias("before_value"), F.coalesce("a", F.lit(0.0)).alias("after_value"))


def latest_lateral(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """Each left row with the newest right row of its key, or NULLs."""
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, "__r.*")
    return left.join(last, list(keys), "left")


def scalar_lookup(df: DataFrame, dimension: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One value a key (the smallest), where a scalar subquery with LIMIT 1 would be used."""
    return df.join(dimension.groupBy(*keys).agg(F.min(value).alias(value)), list(keys), "left")


def asof_snapshot(samples: DataFrame, snaps: DataFrame, keys: Sequence[str], ts: str = "snap_time", unit: str = "day") -> DataFrame:
    """Each sample with the snapshot that is open at its time (the last that begins at or before it), over all keys at once.

    Two levels: within a ``unit`` of time a union in time order and a running last value; from unit to unit a carry over one row a unit. So a key's
    series lies in as many tasks as it has units, and no range condition is needed. ``snaps``: keys, snap_start, begin_snap; of snapshots that begin
    together the one with the greatest number counts. Samples without a time get none."""
    s = snaps.where("snap_start is not null and begin_snap is not null").select(
        *keys, F.col("snap_start").alias("__t"), F.lit(0).alias("__kind"), F.col("begin_snap").alias("__snap"), F.lit(None).alias("__row")
    )
    p = samples.select(
        *keys,
        F.col(ts).alias("__t"),
        F.lit(1).alias("__kind"),
        F.lit(None).cast(s.schema["__snap"].dataType).alias("__snap"),
        F.struct(*[c for c in samples.columns if c not in keys]).alias("__row"),
    )
    u = p.unionByName(s.withColumn("__row", F.lit(None).cast(p.schema["__row"].dataType))).withColumn("__unit", F.date_trunc(unit, "__t"))
    running = W.rowsBetween(W.unboundedPreceding, W.currentRow)
    within = running.partitionBy(*keys, "__unit").orderBy("__t", "__kind", "__snap")
    newest = F.max_by("__snap", F.when(F.col("__kind") == 0, F.struct("__t", "__snap")))
    before = W.partitionBy(*keys).orderBy("__unit").rowsBetween(W.unboundedPreceding, -1)
    carry = u.groupBy(*keys, "__unit").agg(newest.alias("__last")).select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate([*keys, "__unit"])], F.last("__last", ignorenulls=True).over(before).alias("__carry")
    )
    out = u.withColumn("__own", F.last("__snap", ignorenulls=True).over(within)).where("__kind = 1")
    same = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate([*keys, "__unit"])]
    return out.join(carry, same, "left").select(*keys, "__row.*", F.coalesce("__own", "__carry").alias("begin_snap"))


def object_bridge(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Objects named by statements: owner and object where the text has an owner, else the object alone. The OR becomes two equality joins.
    ``texts``: sql_id, owner, object (owner NULL if absent); ``segments``: owner, object and more."""
    t = texts.withColumnsRenamed({"owner": "t_owner", "object": "t_object"})
    full = t.where("t_owner is not null").join(segments, (F.col("t_owner") == F.lower("owner")) & (F.col("t_object") == F.lower("object")))
    bare = t.where("t_owner is null").join(segments, F.col("t_object") == F.lower("object"))
    return full.unionByName(bare).drop("t_owner", "t_object")


def cooccurrence(statements: DataFrame, segments: DataFrame, keys: Sequence[str] = ("dbname", "instance", "begin_snap")) -> DataFrame:
    """Statements and segments of the same snapshots, with the sum of score products. Both sides: keys, entity and ``score``, one row each."""
    j = statements.withColumnRenamed("score", "s1").join(segments.withColumnRenamed("score", "s2"), list(keys))
    return j.groupBy("sql_id", "object_name").agg(F.sum(F.col("s1") * F.col("s2")).alias("signal"), F.count("*").alias("snaps"))


def _signals(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    pairs = left.join(right, list(keys)).groupBy("sql_id", "object_name")
    return pairs.agg(F.sum(F.col("s1") * F.col("s2")).alias("signal"), F.count("*").alias("snaps"))


def _bounds(df: DataFrame, entity: str, score: str, other: DataFrame, other_score: str, keys: Sequence[str]) -> DataFrame:
    """What an entity's signal with any entity of the other side can be at most."""
    ends = other.groupBy(*keys).agg(F.min(other_score).alias("low"), F.max(other_score).alias("high"))
    most = F.greatest(F.lit(0.0), F.col(score) * F.col("low"), F.col(score) * F.col("high"))
    return df.join(ends, list(keys)).groupBy(entity).agg(F.sum(most).alias("bound"))


def _bounded(left: DataFrame, right: DataFrame, k: int, keys: Sequence[str], probes: int, rounds: int) -> tuple[DataFrame, DataFrame, float | None]:
    """``bounded_sides`` of sides with s1 and s2, and the k-th best signal that was found; None if there are fewer pairs or scores that aren't finite."""
    found = None
    for _ in range(rounds):
        u1, u2 = _bounds(left, "sql_id", "s1", right, "s2", keys), _bounds(right, "object_name", "s2", left, "s1", keys)
        n1, n2 = (u.agg(F.count("*"), F.max("bound")).first() for u in (u1, u2))
        if not all(n[1] is not None and math.isfinite(n[1]) for n in (n1, n2)):
            return left, right, None
        # The side of more entities has fewer rows an entity and so the closer bounds: its best are met with all of the other side.
        u, entity, side = (u1, "sql_id", left) if n1[0] > n2[0] else (u2, "object_name", right)
        few = side.join(u.orderBy(F.desc("bound"), entity).limit(probes).select(entity), entity, "left_semi")
        best = _signals(few if side is left else left, few if side is right else right, keys).orderBy(F.desc("signal")).limit(k)
        kth = best.agg(F.count("*").alias("n"), F.min("signal").alias("least")).first()
        if kth["n"] < k:
            break
        found = float(kth["least"])
        reach = F.col("bound") >= found - abs(found) * ROOM
        left = left.join(u1.where(reach).select("sql_id"), "sql_id", "left_semi").select(left.columns)
        right = right.join(u2.where(reach).select("object_name"), "object_name", "left_semi").select(right.columns)
        probes *= 8
    return left, right, found


def bounded_sides(
    statements: DataFrame, segments: DataFrame, k: int, keys: Sequence[str] = ("dbname", "instance", "begin_snap"), probes: int = 32, rounds: int = 2
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides whose entities can be in one of the ``k`` pairs of the greatest signal; scores as s1 and s2.

    In a snapshot a statement's product with any segment is at most its product with the snapshot's extreme segment scores; the sum of these over snapshots
    bounds all of the statement's signals, and likewise a segment's. The signals of the ``probes`` entities of the greatest bounds, on the side that has more
    entities, with all of the other side give a k-th best signal to pass; only statements and segments whose bounds reach it stay. Then bounds are taken anew
    among those that stay, with 8 times the probes. The driver gets a few numbers a round."""
    left, right = statements.select(*keys, "sql_id", F.col("score").alias("s1")), segments.select(*keys, "object_name", F.col("score").alias("s2"))
    return _bounded(left, right, k, keys, probes, rounds)[:2]


#: Share of a signal left as room for sums in another order.
ROOM = 1e-9
#: Rows of one side in a block, and cells of one matrix within a block's task.
BLOCK_ROWS, CELLS = 2_000_000, 4_000_000


def _best_of_block(k: int, least: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of two blocks of entities the pairs whose signal reaches ``least`` (above 0) and the k-th best of the blocks: products of matrices of entities by snapshots."""

    def matrix(codes: np.ndarray, at: np.ndarray, score: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
        own = slice(np.searchsorted(codes, first), np.searchsorted(codes, last))
        flat = (codes[own] - first) * width + at[own]
        return np.bincount(flat, score[own], (last - first) * width).reshape(last - first, width)

    def side(df: pd.DataFrame, entity: str, score: str, snaps: np.ndarray):
        df = df[df["__s"].isin(snaps)]
        codes, names = pd.factorize(df[entity])
        order = np.argsort(codes, kind="stable")
        return codes[order], np.searchsorted(snaps, df["__s"].to_numpy()[order]), df[score].to_numpy()[order], names

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        snaps = np.intersect1d(a["__s"], b["__s"])
        width = len(snaps)
        ca, sa, xa, na = side(a, "sql_id", "s1", snaps)
        cb, sb, xb, nb = side(b, "object_name", "s2", snaps)
        step, bar = max(1, min(2000, CELLS // max(1, width))), least
        v, i, j = np.empty(0), np.empty(0, "int64"), np.empty(0, "int64")
        for p in range(0, len(na), step):
            x = matrix(ca, sa, xa, p, min(p + step, len(na)), width)
            for q in range(0, len(nb), step):
                s = x @ matrix(cb, sb, xb, q, min(q + step, len(nb)), width).T
                hi, hj = np.nonzero(s >= bar)
                v, i, j = np.append(v, s[hi, hj]), np.append(i, hi + p), np.append(j, hj + q)
                if len(v) > k:
                    top = np.partition(v, -k)[-k]
                    bar = max(bar, top - top * ROOM)
                    keep = v >= bar
                    v, i, j = v[keep], i[keep], j[keep]
        return pd.DataFrame({"sql_id": na.take(i), "object_name": nb.take(j), "v": v})

    return best


def _best_by_blocks(left: DataFrame, right: DataFrame, k: int, keys: Sequence[str], least: float, block_rows: int) -> DataFrame:
    """The signals of the pairs among which the ``k`` best are. Entities are dealt to blocks of about ``block_rows`` rows a side, a task multiplies two
    blocks; no pair is shuffled but those that reach the best of their blocks, and these are summed again from their rows."""
    snaps = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys))
    snaps = written(snaps.withColumn("__s", F.monotonically_increasing_id()), "snapshots")
    n1, n2 = (-(-df.count() // block_rows) for df in (left, right))

    def dealt(df: DataFrame, entity: str, score: str, own: int, others: int, mine: str, other: str) -> DataFrame:
        d = df.where(F.col(score).isNotNull() & F.col(entity).isNotNull()).join(snaps, list(keys)).select(entity, F.col("__s").alias("__s"), F.col(score).cast("double").alias(score))
        d = d.withColumn(mine, F.pmod(F.xxhash64(entity), F.lit(own)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    a, b = dealt(left, "sql_id", "s1", n1, n2, "__a", "__b"), dealt(right, "object_name", "s2", n2, n1, "__b", "__a")
    schema = StructType([left.schema["sql_id"], right.schema["object_name"], StructField("v", DoubleType())])
    pairs = a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInPandas(_best_of_block(k, least - least * ROOM), schema)
    pairs = written(pairs, "pairs")
    kth = pairs.orderBy(F.desc("v")).limit(k).agg(F.min("v")).first()[0]
    pairs = pairs.where(F.col("v") >= kth - kth * ROOM).drop("v")
    own = lambda df, entity: df.join(pairs.select(entity).distinct(), entity, "left_semi")
    return _signals(own(left, "sql_id").join(pairs, "sql_id"), own(right, "object_name"), [*keys, "object_name"])


def cooccurrence_top(
    statements: DataFrame, segments: DataFrame, k: int, keys: Sequence[str] = ("dbname", "instance", "begin_snap"), probes: int = 32, rounds: int = 2,
    joined: int = 10_000_000, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """J12, the ``k`` pairs of the greatest signal (by signal, sql_id, object_name), without shuffling all pairs: only those of ``bounded_sides``. Exact:
    a pair that is left out lies below k others. Both sides: keys, entity and ``score``, one row each.

    If the sides that stay meet in at most ``joined`` rows these are joined, else they are multiplied in blocks (``_best_by_blocks``), which needs a
    positive k-th best signal; without one all pairs are joined."""
    left = written(statements.select(*keys, "sql_id", F.col("score").alias("s1")), "statements")
    right = written(segments.select(*keys, "object_name", F.col("score").alias("s2")), "segments")
    left, right, least = _bounded(left, right, k, keys, probes, rounds)
    out = None
    if least is not None and least > 0:
        left, right = written(left, "statements"), written(right, "segments")
        met = left.groupBy(*keys).count().join(right.groupBy(*keys).agg(F.count("*").alias("others")), list(keys))
        if met.agg(F.sum(F.col("count").cast("double") * F.col("others"))).first()[0] > joined:
            out = _best_by_blocks(left, right, k, keys, least, block_rows)
    if out is None:
        out = _signals(left, right, keys)
    return out.orderBy(F.desc("signal"), "sql_id", "object_name").limit(k)


def metadata_enrich(segments: DataFrame, meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metadata by owner and object, else by the object alone; of several the first in order of owner. Columns get the prefix ``m_``."""
    up = lambda c: F.upper(F.col(c).cast("string"))
    m = meta.select(
        up("owner").alias("__o"), up("object_name").alias("__n"), F.struct(*[F.col(c).alias(f"m_{c}") for c in columns]).alias("__m")
    )
    exact = m.groupBy("__o", "__n").agg(F.min("__m").alias("m1"))
    alone = m.groupBy(F.col("__n").alias("__n2")).agg(F.min_by("__m", "__o").alias("m2"))
    j = segments.join(
        exact, (up("owner") == F.col("__o")) & (up("object_name") == F.col("__n")), "left"
    ).join(alone, up("object_name") == F.col("__n2"), "left")
    return j.withColumn("__m", F.coalesce("m1", "m2")).select(*segments.columns, "__m.*")


def driver_left_fetch(driving: DataFrame, others: dict[str, DataFrame], key: str, k: int, *order: Column) -> DataFrame:
    """The top rows of one aggregate with those of others; the limit comes before the joins."""
    out = driving.orderBy(*order).limit(k)
    for o in others.values():
        out = out.join(o, key, "left")
    return out


def with_params(df: DataFrame, **params) -> DataFrame:
    """Constants beside every row. A cross join with a one-row frame folds to this."""
    return df.withColumns({k: F.lit(v) for k, v in params.items()})


def ledger_anti(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that are new: no entry of the same path, and none of the same content that has not failed. Of new files of equal
    content the first path stays. ``candidates``: path, hash; ``ledger``: path, hash, state."""
    new = candidates.join(ledger.select("path").distinct(), "path", "left_anti").join(
        ledger.where("state <> 'failed'").select("hash").distinct(), "hash", "left_anti"
    )
    return new.groupBy("hash").agg(
        F.min_by(F.struct(*[F.col(c) for c in candidates.columns if c != "hash"]), "path").alias("__r")
    ).select("hash", "__r.*")


#: What became of a step: its kind is on both sides, or it is paired by position, or it stands alone.
HOW = ("same", "moved", "removed", "added")


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each value, the same for equal ones."""
    return np.asarray(pc.fill_null(column.dictionary_encode().indices, -1)).astype("int64") + 1


def _begins(x: pa.RecordBatch, keys: int) -> np.ndarray:
    """Whether a row's first columns differ from those of the row before it."""
    return np.logical_or.reduce([np.diff(_codes(x.column(i)), prepend=-1) != 0 for i in range(keys)])


def _whole_plans(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that the rows of equal keys come in one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if held and b.num_rows:
            cut = np.flatnonzero(_begins(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b]), keys)[1:])
        else:
            cut = np.flatnonzero(_begins(b, keys))[1:]
        if len(cut):
            yield pa.concat_batches([*held, b.slice(0, cut[-1])])
            held, b = [], b.slice(cut[-1])
        if b.num_rows:
            held.append(b)
    if held:
        yield pa.concat_batches(held)


def _counterparts(group: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each row the n-th of its group on the other side, if it is the n-th of its own; else -1."""
    run = group * 2 + after
    order = np.argsort(run, kind="stable")
    run = run[order]
    first = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(first, append=len(run))
    facing = np.searchsorted(run, run[first] ^ 1)
    there = np.searchsorted(run, run[first] ^ 1, side="right") - facing
    n = np.arange(len(run)) - np.repeat(first, size)
    met = n < np.repeat(there, size)
    out = np.full(len(run), -1)
    out[order[met]] = order[(np.repeat(facing, size) + n)[met]]
    return out


def _kinds(operation: pa.Array, object_name: pa.Array) -> np.ndarray:
    """A number for each (operation, object), upper-cased, an object of NULL as one of no name."""

    def upper(column: pa.Array, null: str | None) -> np.ndarray:
        d = column.dictionary_encode()
        values = pa.array([*[v.upper() for v in d.dictionary.to_pylist()], null], pa.string())
        return _codes(values)[np.asarray(pc.fill_null(d.indices, len(values) - 1))]

    op, ob = upper(operation, None), upper(object_name, "")
    return _codes(pa.array(op * (ob.max() + 1) + ob))


def _flat(x: pa.RecordBatch, keys: int) -> pa.RecordBatch:
    """Plans as rows with lists of steps (keys, side, steps): a row a step, a plan's in order of their columns."""
    steps = x.column(keys + 1)
    plan = np.repeat(np.cumsum(_begins(x, keys)) - 1, np.asarray(pc.fill_null(pc.list_value_length(steps), 0)))
    row = pa.array(np.repeat(np.arange(x.num_rows), np.asarray(pc.fill_null(pc.list_value_length(steps), 0))))
    columns = steps.flatten().flatten()
    names = [str(i) for i in range(len(columns))]
    order = pc.sort_indices(pa.table([pa.array(plan), *columns], ["plan", *names]), [(c, "ascending") for c in ("plan", *names)], null_placement="at_start")
    taken = [x.column(i).take(row.take(order)) for i in range(keys + 1)]
    return pa.RecordBatch.from_arrays([*taken, *[c.take(order) for c in columns]], [*x.schema.names[: keys + 1], *names])


def _pair_lists(x: pa.RecordBatch, keys: int, columns: Sequence[str], shown: Sequence[str]) -> pa.RecordBatch:
    """Whole plans' steps in order (keys, side, columns): a row a plan with its list of pairs of the shown columns."""
    begins = _begins(x, keys)
    plan, after = np.cumsum(begins) - 1, np.asarray(x.column(keys)).astype("int64")
    column = dict(zip(columns, x.columns[keys + 1 :], strict=True))
    step = pa.StructArray.from_arrays([column[c] for c in shown], list(shown))
    kind = _kinds(column["operation"], column["object_name"])
    mate = _counterparts(plan * (kind.max() + 1) + kind, after)
    how = np.zeros(len(plan), "int64")
    left = np.flatnonzero(mate < 0)
    rest = _counterparts(plan[left], after[left])
    how[left] = np.where(rest >= 0, 1, 2 + after[left])
    mate[left] = np.where(rest >= 0, left[rest], -1)
    at = np.flatnonzero((after == 0) | (mate < 0))  # a pair stands at its step before
    own = after[at] == 0
    taken = lambda i: step.take(pa.array(i, mask=i < 0))
    sides = taken(np.where(own, at, -1)), taken(np.where(own, mate[at], at))
    pairs = pa.StructArray.from_arrays([*sides, pa.array(HOW).take(pa.array(how[at]))], ["before", "after", "how"])
    ends = np.cumsum(np.bincount(plan[at], minlength=plan[-1] + 1))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pairs)
    firsts = pa.array(np.flatnonzero(begins))
    return pa.RecordBatch.from_arrays([*[x.column(i).take(firsts) for i in range(keys)], lists], [*x.schema.names[:keys], "pairs"])


def paired_steps(before: DataFrame, after: DataFrame, keys: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """One row a plan: keys and ``pairs``, an array of before, after (structs of step_id and ``columns``, or null) and how (same, moved, removed,
    added). Steps of equal (operation, object) are paired, the n-th with the n-th, then what is left by position.

    Both sides: keys (plain columns, no structs), step_id, operation, object_name and ``columns``; or keys and ``steps``, an array of structs of these
    (``plan_step_lists``). The steps of a plan are dealt once, by plan, and sorted by step, then ``columns``; the plans of an Arrow batch are
    paired at once by places in sorted arrays. Pairs come out finished: made by column expressions, they would be copied into the filter that Spark infers from
    ``explode``, and into each other's lambdas. Spark measures an Arrow batch at each of its rows, so lists of steps take far less time."""
    shown = list(dict.fromkeys(("step_id", *columns)))
    used = list(dict.fromkeys((*shown, "operation", "object_name")))
    n, listed = len(keys), "steps" in before.columns

    def side(df: DataFrame, after: int) -> DataFrame:
        key = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)]
        own = [F.transform("steps", lambda s: F.struct(*[s[c].alias(c) for c in used])).alias("__steps")] if listed else [F.col(c) for c in used]
        kept = df.schema["steps"].dataType.elementType.names == used if listed else False
        return df.select(*key, F.lit(after).alias("__after"), *([F.col("steps").alias("__steps")] if kept else own))

    both = side(before, 0).union(side(after, 1)).repartition(*[f"__k{i}" for i in range(n)])
    both = both.sortWithinPartitions(*[c for c in both.columns if c.startswith("__k")], *([] if listed else used))
    fields = both.schema.fields
    kind = {f.name: f.dataType for f in (fields[-1].dataType.elementType if listed else fields[n + 1 :])}
    one = StructType([StructField(c, kind[c]) for c in shown])
    pair = StructType([StructField("before", one), StructField("after", one), StructField("how", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_plans(batches, n):
            flat = _flat(b, n) if listed else b
            if flat.num_rows:
                yield _pair_lists(flat.rename_columns([*keys, *flat.schema.names[n:]]), n, used, shown)

    key_fields = [StructField(c, f.dataType) for c, f in zip(keys, fields)]
    return both.mapInArrow(run, StructType([*key_fields, StructField("pairs", ArrayType(pair))]))


def step_match(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("plan",)) -> DataFrame:
    """J18, one row a pair (``paired_steps``): keys, step_before, step_after, how (same, moved, removed, added)."""
    d = paired_steps(before, after, keys).select(*keys, F.explode("pairs").alias("p"))
    return d.select(*keys, F.col("p.before.step_id").alias("step_before"), F.col("p.after.step_id").alias("step_after"), "p.how")
