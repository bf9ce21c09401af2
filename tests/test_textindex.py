"""The trigram index finds what a scan finds, and reads no more texts than it must."""

import random

import pytest
from pyspark.sql import functions as F

from vitalspark.operators import select
from vitalspark.operators.textindex import TextIndex, index_step
from vitalspark.sinks import KeyedTable

COLUMNS = "id long, snap int, sql_text string, label string"
ODD = [
    (None, 1, "SELECT 100% of a_b", None),
    (1, 1, None, None),
    (2, 1, "", "ab"),
    (3, 1, "two\nlines and \\ a slash", "Straße"),
    (4, 2, "😀x😀y", "100% A_B"),
    (4, 2, "😀x😀y", "100% A_B"),
    (5, 2, "abXcd", "bxc"),
    (6, 2, "İstanbul ΣΑΣ", "aaaaaa"),
]
QUERIES = ["100%", "a_b", "A_B", "x😀", "😀x😀", "s\nlin", "\\ a", "STRASSE", "straß", "ab", "", "bxc", "σας", "İst", "aaaa", "nowhere", "select 1", "%"]


def _rows(df):
    return sorted(str(tuple(r[c] for c in ("id", "snap", "sql_text", "label"))) for r in df.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    r = random.Random(3)
    words = ["select", "from", "where", "orders", "Lineitem", "join", "rare", "x1"]
    many = [(100 + i, 3 + i % 2, " ".join(r.choices(words[:6], k=8)) + (" needle7" if i == 333 else ""), r.choice(words)) for i in range(600)]
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), ["id", "snap"], ["sql_text", "label"], slots=8, parts=24)
    frames = [spark.createDataFrame(x, COLUMNS) for x in (ODD, many[:300], many[300:])]
    for k, f in enumerate(frames):
        index.load(f"l{k}", f)
    index.load("l1", frames[1])  # an earlier try is replaced
    index.load("l3", frames[0].where("false"))
    return index, frames[0].union(frames[1]).union(frames[2])


@pytest.mark.parametrize("query", [*QUERIES, "from where", "needle7", "ERE OR"])
def test_search_equals_a_scan(built, query):
    index, whole = built
    want = whole.where(select.contains(F.col("sql_text"), query) | select.contains(F.col("label"), query))
    assert _rows(index.search(query)) == _rows(want)


def test_what_is_read(built):
    index, _ = built
    wanted = index.rarest("needle7")
    found = index.candidates(wanted)
    assert found.count() == 1
    read = index.read_for(found)
    assert 0 < read.count() < 608 / 8
    assert read.select("part").distinct().count() == 1 and len(index._table("texts").select("part").distinct().collect()) == 24
    postings = index._of(index._table("postings"), wanted)
    assert postings.select(F.input_file_name()).distinct().count() <= 3 * len(wanted)
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "part" in plan.split("PartitionFilters")[1]
    assert index.rarest("nowhere at all") is None and index.rarest("se") == []


def test_texts_without_grams(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path), ["id"], ["sql_text"], slots=4, parts=4)
    index.load("a", spark.createDataFrame([(1, "ab"), (2, None)], "id long, sql_text string"))
    assert [r["id"] for r in index.search("B").collect()] == [1]
    assert index.search("abc").count() == 0


def test_step_of_the_chain(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["db"])
    index = TextIndex(spark, str(tmp_path / "i"), ["db", "snap", "id"], ["sql_text"], slots=4, parts=4)
    step = index_step(index, table, ["db", "snap"])
    rows = lambda snap: spark.createDataFrame([("a", snap, i, f"Text {snap}-{i} of statement") for i in range(3)], "db string, snap int, id int, sql_text string")
    for snap in (1, 2):
        table.insert_if_absent(rows(snap), ["db", "snap", "id"])
        for _ in range(2):  # a step that failed before its mark runs again
            step(rows(snap).select("db", "snap").distinct())
    assert sorted(r["sql_text"] for r in index.search("TEXT 2-").collect()) == [f"Text 2-{i} of statement" for i in range(3)]
    assert index.search("statement").count() == 6


def test_a_gram_is_a_row_for_many_texts(spark, tmp_path, monkeypatch):
    """Postings are rows of grams, not of grams and texts, and those of texts taken in pieces are the same."""
    index = TextIndex(spark, str(tmp_path), ["id"], ["sql_text"], slots=4, parts=2)
    index.load("a", spark.createDataFrame([(i, f"the same words and {i}") for i in range(400)], "id long, sql_text string").coalesce(1))
    rows = index._table("postings").where("gram = 'wor'").collect()
    assert sum(r["n"] for r in rows) == 400 and len(rows) <= 8
    assert len({(r["part"], t) for r in rows for t in r["texts"]}) == 400
    assert index.search("AND 17").count() == 11


@pytest.mark.parametrize("texts", [["aXbaXb", "", "aXb", "\x00\x00\x00a"], ["😀x😀y", "ab", "x😀y\n"], ["".join(map(chr, range(0x10000 + 40000 * k, 0x10000 + 40000 * k + 9000))) for k in range(26)] + ["abc"] * 1500])
def test_postings_against_plain_python(texts):
    import numpy as np

    from vitalspark.operators.textindex import postings

    n = len(texts)
    got = [r for b in postings(texts, np.arange(n) // 2, np.arange(n) + 100, 0) for r in b.to_pylist()]
    want = {(t[k : k + 3], i // 2, i + 100) for i, t in enumerate(texts) for k in range(len(t) - 2)}
    assert sorted((r["gram"], r["part"], t) for r in got for t in r["texts"]) == sorted(want)
    assert all(r["n"] == len(r["texts"]) for r in got)
