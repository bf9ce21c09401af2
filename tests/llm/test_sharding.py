"""Cut links of the placed documents against the start and against the best of all placings."""

from itertools import combinations

import pytest

sharding = pytest.importorskip("vitalspark.llm.sharding")
from pyspark.sql import functions as F  # noqa: E402


def plain_cut(groups, first):
    return sum(groups[i] == groups[j] and (i in first) != (j in first) for i, j in combinations(range(len(groups)), 2))


def test_cut_against_the_best_placing(docs_of):
    texts = ["a"] * 4 + ["b"] * 3 + ["c"] * 2 + ["d"]
    d = docs_of(texts)
    rows = sharding.shard_documents(d, shards=2)
    found = rows.collect()
    got = sharding.cut_links(rows).first()
    assert (int(got["links"]), int(got["cut"])) == (6 + 3 + 1, plain_cut(texts, {r["doc_id"] for r in found if r["shard"] == 0}))
    best = min(plain_cut(texts, set(x)) for x in combinations(range(10), 5))
    begin = sharding.cut_links(d.select(F.col("text").alias("group"), sharding.start_shard(2, "doc_id").alias("shard"))).first()
    assert best <= int(got["cut"]) <= int(begin["cut"])


def test_links_within_shards_of_many_groups(docs_of):
    texts = [f"pair {i // 3}" if i % 2 else f"alone {i}" for i in range(1200)]
    d = docs_of(texts)
    got = sharding.cut_links(sharding.shard_documents(d)).first()
    begin = sharding.cut_links(d.select(F.col("text").alias("group"), sharding.start_shard(8, "doc_id").alias("shard"))).first()
    assert int(got["links"]) == int(begin["links"]) and int(got["cut"]) <= 0.1 * int(begin["cut"])
