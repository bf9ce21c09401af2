"""Near-duplicates in template families, with repeated ids, and with one text on a third of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

minhash_dedup = pytest.importorskip("vitalspark.llm.minhash_dedup")
from vitalspark.llm.scratch import Scratch  # noqa: E402
from vitalspark.llm.spread import spread_join  # noqa: E402


def test_a_link_within_a_family_of_two_thousand(docs_of):
    """2,000 pages of one template are 0.67 alike; two more are 0.79 like each other and 0.72 like the rest."""
    shared = [f"t{k}" for k in range(100)]
    texts = [" ".join(shared + [f"m{i}w{k}" for k in range(24 if i < 2000 else 13)]) for i in range(2002)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.op1_minhash_dedup(docs_of(texts)).collect()}
    assert got == {i: i for i in range(2001)} | {2001: 2000}


def _prefix_pairs(spark, docs):
    rows = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component"), "text").repartition(3)
    scratch = Scratch(spark, "prefix-test")
    counts = np.zeros(1 << minhash_dedup.SLOT_BITS, np.int64)
    for x in rows.select("text").mapInArrow(minhash_dedup._slot_counts, "slot long, n long").collect():
        counts[x["slot"]] += x["n"]
    kind = "token long, id long, component long, n long, place long, indexed boolean"
    prefixes = scratch.table(rows.mapInArrow(minhash_dedup._prefixes(spark.sparkContext.broadcast(counts), 75), kind))
    return {(x["a"], x["b"]) for x in minhash_dedup._prefix_pairs(prefixes, 75, scratch).collect()}


def test_prefix_pairs_hold_every_link(spark, docs_of):
    """Every pair of 75 % or more comes out of the prefixes, in families whose members are 0.6 to 1 alike; hardly any pair between families does."""
    r = random.Random(5)
    texts = [None, "", "one two", "one two"]
    for family in range(6):
        shared = [f"f{family}s{k}" for k in range(120)]
        for i in range(40):
            own = list(shared)
            for _ in range(r.randrange(5)):
                own[r.randrange(120)] = f"u{r.randrange(1000)}"
            texts.append(" ".join(own + [f"e{r.randrange(30)}"] * r.randrange(8)))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").split() for t in texts)]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    pairs = _prefix_pairs(spark, docs_of(texts))
    assert len(links) > 300 and links <= pairs
    between = {(i, j) for i, j in pairs if (i - 4) // 40 != (j - 4) // 40}
    assert len(between) < 0.05 * 15 * 40 * 40


def test_a_template_makes_no_pairs(spark, docs_of):
    shared = [f"t{k}" for k in range(100)]
    assert _prefix_pairs(spark, docs_of([" ".join(shared + [f"m{i}w{k}" for k in range(24)]) for i in range(300)])) == set()


def test_rows_that_repeat_an_id_are_one_document(docs_of):
    text = " ".join(f"w{k}" for k in range(40))
    d = docs_of([text, text, text + " end", "other words stand here in this text", None, ""], ids=[5, 5, 7, 5, None, 8])
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash_dedup.op1_minhash_dedup(d).collect())
    assert rows == [("5", 5, True)] * 3 + [("7", 5, False), ("8", 8, True), ("None", None, None)]


def test_copies_of_one_text_on_a_third_of_all_rows(docs_of):
    texts = [
        "the same page of twelve words is here again and again today" if i % 3 == 0 else f"a{i} b{i} c{i} d{i} e{i} f{i}"
        for i in range(3000)
    ]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.op1_minhash_dedup(docs_of(texts)).collect()}
    assert got == {i: 0 if i % 3 == 0 else i for i in range(3000)}


def test_spread_join_equals_a_join(spark):
    large = spark.createDataFrame([(0 if i % 3 == 0 else i % 50, i) for i in range(999)] + [(None, 1)], "k long, x long")
    small = large.groupBy("k").count().where("k is null or k % 2 = 0")
    got = sorted(spread_join(large, small, ["k"], "count", 1000, parts=16).collect())
    assert got == sorted(large.join(small, "k").collect())
    left = spread_join(large, small, ["k"], "count", 1000, "left", parts=16)
    assert sorted(map(str, left.collect())) == sorted(map(str, large.join(small, "k", "left").collect()))
