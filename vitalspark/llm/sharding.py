"""Sharding by balanced label propagation: linked documents move towards their neighbours' shard under capacity quotas.

Documents with equal texts are linked. Every document starts in the shard its id hashes to. In each round a linked document asks for the
shard that holds most of its group, of those not yet full; the driver sees only the table of wishes by (from, to) - shards squared numbers - and cuts it
to quotas that keep every shard's linked documents within its share; wishes are granted largest groups first. A target that cannot take all that is wished
is filled to its last place, so the rest of a large group wishes for the next open shard; rounds go on until nothing is wished. They end: a move
only ever goes to a shard that holds at least as many of the group as the one it leaves, so the sum of squares grows. At the end the surplus of
each shard moves to shards with room, unlinked documents first, until the counts are at most one apart (law ``rows``).

Ranks are never taken in one task: rows are counted in (class, bucket) cells, of which there is a bounded number, and a row's rank is its
number within its cell plus the sum of the cells before. A group that holds more than a shard's share is split by the
quotas. Frequent texts are dealt to several tasks in every join. ``cut_links`` counts the links between shards, for the start and the
end. Null texts count as empty ones. Ids must be unique. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch
from .spread import spread_join


def ranked(df: DataFrame, by: list[str], order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row among those of equal ``by``, ordered by ``order`` (few values), a hash and the id."""
    buckets = min(16_384, max(64, rows // 256))
    cell = [*by, *order, "__bucket"]
    d = df.withColumn("__bucket", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(buckets)).cast("int"))
    counts = d.groupBy(*cell).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*by).orderBy(*order, "__bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = d.withColumn("__row", F.row_number().over(W.partitionBy(*cell).orderBy("id")))
    return own.join(counts.drop("__n"), cell).withColumn(name, F.col("__row") - 1 + F.col("__before")).drop("__bucket", "__row", "__before")


def quotas(wishes: dict[tuple[int, int], int], counts: list[int], most: list[int]) -> dict[tuple[int, int], int]:
    """The largest shares of the wishes, cut down per target, that leave no shard above ``most``. A target whose wishes are cut is filled: what
    rounding leaves goes to its largest wishes. Every pass but the last cuts something, so the passes end."""
    granted = dict(wishes)
    while True:
        done = True
        for t in range(len(counts)):
            into = sum(n for (_, b), n in granted.items() if b == t)
            out = sum(n for (a, _), n in granted.items() if a == t)
            room = max(0, most[t] - counts[t] + out)
            if into > room:
                done = False
                wished = {k: n for k, n in granted.items() if k[1] == t}
                granted.update({k: n * room // into for k, n in wished.items()})
                left = room - sum(granted[k] for k in wished)
                for k in sorted(wished, key=lambda k: (-wished[k], k))[:left]:
                    granted[k] += 1
        if done:
            return granted


def _quota(of: dict[tuple[int, int], int], a: str, b: str) -> F.Column:
    out = F.lit(0)
    for (x, y), n in of.items():
        out = F.when((F.col(a) == x) & (F.col(b) == y), F.lit(n)).otherwise(out)
    return out


def cut_links(placed: DataFrame) -> DataFrame:
    """One row (links, cut): pairs of documents with equal texts, and those of them in different shards, from counts by (group, shard). ``placed``: group, shard."""
    own = placed.groupBy("group", "shard").agg(F.count("*").cast("decimal(19,0)").alias("n")).groupBy("group").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("square")
    )
    pairs = own.select(
        ((F.col("all") * F.col("all") - F.col("all")) / 2).alias("links"),
        ((F.col("all") * F.col("all") - F.col("square")) / 2).alias("cut"),
    )
    return pairs.agg(
        F.coalesce(F.sum("links"), F.lit(0)).cast("decimal(38,0)").alias("links"),
        F.coalesce(F.sum("cut"), F.lit(0)).cast("decimal(38,0)").alias("cut"),
    )


def start_shard(shards: int, id_column: str = "id") -> F.Column:
    """The shard in which a document begins."""
    return F.pmod(F.xxhash64(F.col(id_column), F.lit(5)), F.lit(shards)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, size, text_crc32, group, shard, slot) of every row."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_column), F.lit(""))
    nodes = docs.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("group"),
        start_shard(shards, id_column).alias("shard"),
    )
    state = scratch.table(nodes)

    def counted(df: DataFrame) -> list[int]:
        found = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
        return [found.get(s, 0) for s in range(shards)]

    total = sum(counted(state))
    share = [total // shards + (s < total % shards) for s in range(shards)]
    groups = scratch.table(
        state.groupBy("group").agg(F.count("*").alias("members")).where("members > 1").withColumn(
            "heavy", -F.floor(F.log2("members")).cast("int")
        )
    )
    cols = ["id", "size", "text_crc32", "group", "shard", "heavy"]
    first = state
    state = scratch.table(spread_join(state, groups, ["group"], "members", total, "left").select(*cols))
    scratch.drop(first, groups)
    while True:
        linked = state.where("heavy is not null")
        filled = counted(linked)
        open_ = F.col("shard").isin([s for s in range(shards) if filled[s] < share[s]])
        held = linked.where(open_).groupBy("group", "shard").agg(F.count("*").alias("n"))
        want = scratch.table(
            held.groupBy("group").agg(
                F.max_by("shard", F.struct("n", -F.col("shard"))).alias("want"), F.count("*").alias("places"), F.sum("n").alias("members")
            ).where("places > 1").select("group", "want", "members")
        )
        asked = scratch.table(
            spread_join(state, want, ["group"], "members", total, "left").drop("members").withColumn(
                "want", F.when(open_ & (F.col("want") != F.col("shard")), F.col("want"))
            )
        )
        wishes = {(r["shard"], r["want"]): r["count"] for r in asked.where("want is not null").groupBy("shard", "want").count().collect()}
        granted = {k: n for k, n in quotas(wishes, filled, share).items() if n}
        if not granted:
            break
        moved = ranked(asked.where("want is not null"), ["shard", "want"], ["heavy"], total)
        moved = moved.withColumn("shard", F.when(F.col("rank") < _quota(granted, "shard", "want"), F.col("want")).otherwise(F.col("shard")))
        new = scratch.table(asked.where("want is null").select(*cols).union(moved.select(*cols)))
        scratch.drop(state, want, asked)
        state = new
    # Exact counts: what each shard has too much goes, in order of rank, to the shards with room.
    surplus = [c - x for c, x in zip(counted(state), share, strict=True)]
    room = [max(0, -x) for x in surplus]
    begin, out = 0, F.col("shard")
    pooled, given = F.lit(None).cast("long"), 0
    for s, x in enumerate(surplus):
        if x > 0:
            pooled = F.when((F.col("shard") == s) & (F.col("rank") < x), F.col("rank") + given).otherwise(pooled)
            given += x
    for s, x in enumerate(room):
        if x:
            out = F.when((F.col("pool") >= begin) & (F.col("pool") < begin + x), F.lit(s)).otherwise(out)
            begin += x
    if given:
        cost = state.withColumn("linked", F.coalesce(-F.col("heavy"), F.lit(0)))
        state = scratch.table(ranked(cost, ["shard"], ["linked"], total).withColumn("pool", pooled).withColumn("shard", out).select(*cols))
    scratch.drop_all(state)
    placed = ranked(state, ["shard"], [], total, "slot")
    return placed.select(F.col("id").alias(id_column), "size", "text_crc32", "group", "shard", F.col("slot").cast("long").alias("slot"))


def op8_sharding(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
