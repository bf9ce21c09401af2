"""Document fingerprints: a Merkle tree over runs of words, paragraphs and sections, in DataFrame expressions only.

A section is what stands between blank lines, a paragraph a line of it, a leaf a run of at most ``LEAF`` words that ends with the first word that ends in
a punctuation mark, so that an edit moves the leaves of its own sentence only; words are cut at ``LEAF_CHARS`` characters, and each line's end is a leaf.
A node's SHA-256 is made of its children's, so equal roots mean equal texts. The fingerprint is the root (hex).

Two trees are compared from the top: equal sections at both ends are left aside by their hashes, then equal paragraphs of what is between, then
equal leaves. What is left are the branches that differ; they locate the edit (``edit_start`` to ``edit_end``, characters). Likeness is a weighted
Jaccard index: the characters of leaves that both trees have, as a share of the characters of all leaves of either, repeats counted. Branches left
aside are common to both, so only leaves under differing ones are matched. It is 1 for equal texts, also for two empty ones.

Null texts count as empty. Rows of one id are ordered by text, rows without an id come last. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAF, LEAF_CHARS = 8, 96
#: Cut points for the order by id that reach the driver, and the rows of a range that a task sorts: ranges between cut points are cut further
#: by number, as many times as the table's size asks for.
CUTS, RANGE_ROWS = 64, 20_000
_LEAVES = rf"(?:[^\s]{{0,{LEAF_CHARS - 1}}}[^\s.,;:!?][^\S\n]+){{0,{LEAF - 1}}}[^\s]{{1,{LEAF_CHARS}}}[^\S\n]*|[^\S\n]+"


def leaf_texts(line: F.Column) -> F.Column:
    """The leaves of a line in order; joined they give the line back."""
    return F.regexp_extract_all(line, F.lit(_LEAVES), F.lit(0))


def tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds a tree's levels, each in order over the whole text: ``sections`` and ``paragraphs`` (hash and number of children), ``leaves``
    (hash and length) and ``fingerprint`` (the root). The last leaf of a line is its end: two line feeds at a section's end, else one."""
    node = lambda x: F.struct(F.sha2(x, 256).alias("h"), F.char_length(x).alias("n"))
    joined = lambda nodes, sep: F.sha2(F.array_join(F.transform(nodes, lambda x: x["h"]), sep), 256).alias("h")
    ends = F.array(*[F.struct(F.sha2(F.lit(x), 256).alias("h"), F.lit(len(x)).alias("n")) for x in ("\n", "\n\n")])

    def section(lines: F.Column) -> F.Column:
        end = lambda i: F.slice(ends, F.when(i == F.size(lines) - 1, 2).otherwise(1), F.lit(1))
        return F.transform(lines, lambda line, i: F.concat(F.transform(leaf_texts(line), node), end(i)))

    own = df.withColumn("__leaves", F.transform(F.split(text, "\n\n", -1), lambda s: section(F.split(s, "\n", -1))))
    paragraphs = F.transform("__leaves", lambda s: F.transform(s, lambda p: F.struct(joined(p, "."), F.size(p).alias("k"))))
    own = own.withColumns({"__paragraphs": paragraphs, f"{prefix}leaves": F.flatten(F.flatten("__leaves"))}).drop("__leaves")
    sections = F.transform("__paragraphs", lambda s: F.struct(joined(s, "/"), F.size(s).alias("k")))
    own = own.withColumns({f"{prefix}sections": sections, f"{prefix}paragraphs": F.flatten("__paragraphs")}).drop("__paragraphs")
    return own.withColumn(f"{prefix}fingerprint", joined(F.col(f"{prefix}sections"), "|"))


def _alike(x: F.Column, y: F.Column) -> F.Column:
    """How many nodes at the beginning have equal hashes."""
    same = F.zip_with(x, y, lambda a, b: a["h"].eqNullSafe(b["h"]))
    return F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, F.size(same))


def _rest(x: F.Column, front: F.Column, back: F.Column) -> F.Column:
    return F.slice(x, front + 1, F.size(x) - front - back)


def _total(x: F.Column, of: str) -> F.Column:
    return F.aggregate(x, F.lit(0).cast("int"), lambda acc, v: acc + v[of])


def compare(df: DataFrame, a: str, b: str, prefix: str = "") -> DataFrame:
    """Adds ``differ_a`` and ``differ_b``, the leaves under differing branches of the trees with the prefixes a and b, ``edit_start`` and ``edit_end``,
    the characters of a that they span, and ``near``, the likeness of the trees."""
    front, back = F.lit(0), F.lit(0)  # children known to be equal at both ends of the level below
    temporary = []
    for level in ("sections", "paragraphs", "leaves"):
        x, y, skip = f"{a}{level}", f"{b}{level}", [f"__{level}_{k}" for k in ("front", "back", "x", "y", "p", "s")]
        df = df.withColumns({skip[0]: front, skip[1]: back})
        df = df.withColumns(
            {skip[2]: _rest(F.col(x), F.col(skip[0]), F.col(skip[1])), skip[3]: _rest(F.col(y), F.col(skip[0]), F.col(skip[1]))}
        )
        df = df.withColumn(skip[4], _alike(F.col(skip[2]), F.col(skip[3])))
        zero = F.lit(0)
        df = df.withColumns({skip[2]: _rest(F.col(skip[2]), F.col(skip[4]), zero), skip[3]: _rest(F.col(skip[3]), F.col(skip[4]), zero)})
        df = df.withColumn(skip[5], _alike(F.reverse(skip[2]), F.reverse(skip[3])))
        ahead, behind = F.col(skip[0]) + F.col(skip[4]), F.col(skip[1]) + F.col(skip[5])
        of = "n" if level == "leaves" else "k"
        front = _total(F.slice(x, F.lit(1), ahead), of)
        back = _total(F.slice(x, F.size(x) - behind + 1, behind), of)
        temporary += skip
    rest = lambda k: _rest(F.col(f"__leaves_{k}"), F.lit(0), F.col("__leaves_s"))
    df = df.withColumns(
        {
            f"{prefix}differ_a": rest("x"),
            f"{prefix}differ_b": rest("y"),
            f"{prefix}edit_start": front,
            "__back": back,
            "__all": _total(F.col(f"{a}leaves"), "n"),
            "__other": _total(F.col(f"{b}leaves"), "n"),
        }
    )
    end = F.greatest(F.col("__all") - F.col("__back"), F.col(f"{prefix}edit_start"))
    near = likeness(F.col(f"{prefix}differ_a"), F.col(f"{prefix}differ_b"), (F.col("__all") + F.col("__other")).cast("long"))
    return df.withColumns({f"{prefix}edit_end": end, f"{prefix}near": near}).drop(*temporary, "__back", "__all", "__other")


def likeness(a: F.Column, b: F.Column, total: F.Column) -> F.Column:
    """Weighted Jaccard index of two trees of ``total`` characters together, from the leaves a and b that may differ: both are sorted into one array,
    where equal leaves stand together."""
    signed = lambda x, s: F.transform(x, lambda y: F.struct(y["h"].alias("h"), y["n"].cast("long").alias("n"), F.lit(s).alias("s")))
    both = F.array_sort(F.concat(signed(a, 1), signed(b, -1)))
    zero = F.struct(F.lit("").alias("h"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("open"), F.lit(0).cast("long").alias("differ"))

    def step(acc: F.Column, x: F.Column) -> F.Column:
        same = acc["h"] == x["h"]
        differ = acc["differ"] + F.when(same, F.lit(0)).otherwise(acc["n"] * F.abs(acc["open"]))
        return F.struct(
            x["h"].alias("h"),
            x["n"].alias("n"),
            F.when(same, acc["open"] + x["s"]).otherwise(x["s"]).alias("open"),
            differ.cast("long").alias("differ"),
        )

    differ = F.aggregate(both, zero, step, lambda acc: acc["differ"] + acc["n"] * F.abs(acc["open"]))
    # |A and B| = (total - differ) / 2, |A or B| = (total + differ) / 2
    return F.when(total == 0, F.lit(1.0)).otherwise((total - differ) / (total + differ))


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``next_text``: the text that follows in descending order of ``id``, for the last row that of the first.

    Rows are dealt to ranges of ids: between cut points (percentiles, at most CUTS), and within these by number, so that a range has about
    ``range_rows`` rows; within a range the next row is one ahead; a range's last row gets the first row of the next range that has any,
    through a table of one row a range. Rows without an id are dealt by their text's hash."""
    found = docs.agg(
        F.percentile_approx("id", [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("c"),
        F.min("id").alias("lo"),
        F.max("id").alias("hi"),
        F.count("*").alias("n"),
    ).first()
    cuts = sorted({*(found["c"] or []), *([found["hi"]] if found["hi"] is not None else [])})
    finer = -(-found["n"] // (CUTS * range_rows))

    def search(lo: int, hi: int) -> F.Column:  # binary search as nested conditions
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") <= cuts[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    held = docs.withColumn("bucket", search(0, len(cuts) - 1).cast("long"))
    if finer > 1 and cuts:
        lows, highs = (F.array(*map(F.lit, x)) for x in ([found["lo"] - 1, *cuts[:-1]], cuts))
        at = (F.col("bucket") + 1).cast("int")
        share = (F.col("id") - F.element_at(lows, at) - 1) / (F.element_at(highs, at) - F.element_at(lows, at))
        held = held.withColumn("bucket", F.col("bucket") * finer + F.least(F.floor(share * finer), F.lit(finer - 1)))
    held = held.withColumn(
        "bucket", F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("text"), F.lit(CUTS * finer))).otherwise(F.col("bucket"))
    )
    order = W.partitionBy("bucket").orderBy(F.desc("id"), F.desc("text"))
    own = held.withColumns(
        {"next_text": F.lead("text").over(order), "at": F.row_number().over(order), "of": F.count("*").over(W.partitionBy("bucket"))}
    )
    first = F.struct(F.coalesce(F.col("id"), F.lit(0)), F.col("text"))  # a bucket has rows with ids or rows without
    firsts = held.groupBy("bucket").agg(F.max_by("text", first).alias("first_text"))
    # The range before in descending order: the largest bucket number below, or the largest of all.
    downwards = W.orderBy(F.desc("bucket"))
    numbers = firsts.select("bucket").withColumn("follow", F.coalesce(F.lead("bucket").over(downwards), F.first("bucket").over(downwards)))
    ahead = numbers.join(firsts.withColumnRenamed("bucket", "follow"), "follow").select("bucket", "first_text")
    joined = own.join(
        ahead.withColumnRenamed("bucket", "__bucket"), (F.col("bucket") == F.col("__bucket")) & (F.col("at") == F.col("of")), "left"
    )
    return joined.select(*docs.columns, F.coalesce("next_text", "first_text").alias("next_text"))


def op3_fingerprints(docs: DataFrame) -> DataFrame:
    """Besides the contract's columns ``edit_start`` and ``edit_end``: the characters of the text under branches that the edited text doesn't share."""
    d = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    out = with_next(d).select("id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    out = out.withColumn("edited_sha256", F.sha2("edited", 256))
    out = tree(tree(tree(out, "text", "own_"), "edited", "edited_"), "next_text", "next_").drop("text", "edited", "next_text")
    out = compare(compare(out, "own_", "edited_", "e_"), "own_", "next_", "n_")
    at = lambda c: F.least(F.col(c).cast("long"), F.col("n_chars")).alias(c.removeprefix("e_"))
    return out.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.col("own_fingerprint").alias("fingerprint"), "edited_fingerprint",
        F.col("e_near").alias("near_edited"), F.col("n_near").alias("near_next"), at("e_edit_start"), at("e_edit_end"),
    )
