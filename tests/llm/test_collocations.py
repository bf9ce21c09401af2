"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import pytest

collocations = pytest.importorskip("vitalspark.llm.collocations")
from vitalspark.llm.scratch import Scratch  # noqa: E402


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def counted(texts, langs, longest=4):
    f = Counter()
    for t, lang in zip(texts, langs):
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f.update(("und" if lang is None else lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return f


def plain(texts, langs, least=30, top=2000, percent=80):
    f = counted(texts, langs)
    found = {p: a for p, a in f.items() if len(p[1]) >= 2 and a >= least}
    out = []
    for lang in {p[0] for p in f}:
        ranked = []
        for (of, w), a in found.items():
            if of != lang:
                continue
            k = len(w)
            longer = (b for (g, v), b in found.items() if g == lang and len(v) > k and any(v[i : i + k] == w for i in range(len(v) - k + 1)))
            if any(100 * b >= percent * a for b in longer):
                continue
            s, j, left, right = min((2000000 * a // (f[lang, w[:j]] + f[lang, w[j:]]), j, f[lang, w[:j]], f[lang, w[j:]]) for j in range(1, k))
            ranked.append((-s, -a, " ".join(w).encode(), left, right))
        n = sum(c for (g, v), c in f.items() if g == lang and len(v) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "of", "é", "日本", "x1", "house", "tax", "white", "re"]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "!?", " - "]
    texts, langs = [], []
    for i in range(n):
        t = "".join(rng.choice(words[: rng.choice([3, 10])]) + rng.choices(marks, [12, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 60)))
        texts.append(t)
        langs.append(rng.choice(["en", "en", "de", None, ""]))
    return texts + [None, "", " \t", ".,;"] + ["white house"] * 40, langs + ["en", "fr", None, "xx"] + ["en"] * 40


def rows(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_query(spark, docs_of):
    texts, langs = made(1)
    got = rows(collocations.op13_collocations(docs_of(texts, langs).repartition(5)))
    assert got == plain(texts, langs) and len(got) > 20


@pytest.mark.parametrize("shards,bits,least,top", [(1, 1 << 10, 12, 5), (2, 64, 9, 2000), (5, 1 << 16, 30, 3)])
def test_shards_and_maps_do_not_change_results(spark, docs_of, shards, bits, least, top):
    """64 bits: the maps take nearly everything for active."""
    texts, langs = made(shards)
    scratch = Scratch(spark, "t")
    counts = collocations.phrase_counts(docs_of(texts, langs).repartition(4), scratch, shards=shards, bits=bits, least=least)
    have = {(r["lang"], tuple(r["phrase"].split(" "))): r["n"] for r in counts.where("k > 0").collect()}
    assert have == {p: a for p, a in counted(texts, langs).items() if a >= least}
    assert rows(collocations.collocations(counts, scratch, top=top)) == plain(texts, langs, least, top)


def test_longer_phrases_begin_in_the_midst_of_a_cycle(spark, docs_of, monkeypatch):
    """A phrase that is frequent from the start is known after one cycle and a step for each word more, not after a cycle for each length."""
    steps = []
    added = collocations._added
    monkeypatch.setattr(collocations, "_added", lambda state, counts, step, *more: steps.append(step) or added(state, counts, step, *more))
    counts = collocations.phrase_counts(docs_of(["a b c d."] * 400), Scratch(spark, "t"), shards=6, least=30)
    assert {r["phrase"]: r["n"] for r in counts.where("k > 0").collect()} == dict.fromkeys(["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d", "a b c d"], 400)
    assert len(steps) == 6 + 3


def test_score_past_64_bits(spark):
    big = [(9 * 10**18, 9 * 10**18, 9 * 10**18), (4 * 10**18 + 7, 9 * 10**18 + 5, 5 * 10**18 + 1), (30, 31, 30)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(collocations.score(*map(collocations.F.col, "alr"))).collect()
    assert [r[0] for r in got] == [2000000 * a // (left + right) for a, left, right in big]


def test_long_text_and_empty_table(spark, docs_of):
    long = "alpha beta gamma " * 60_000
    assert rows(collocations.op13_collocations(docs_of([long, "alpha beta"], ["en", None]))) == plain([long, "alpha beta"], ["en", None])
    assert rows(collocations.op13_collocations(docs_of([]))) == []
    assert rows(collocations.op13_collocations(docs_of([None, "", "one"], [None, "en", "en"]))) == []
