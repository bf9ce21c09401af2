"""Trees, located edits and likeness against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

fingerprints = pytest.importorskip("vitalspark.llm.fingerprints")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaves(text):
    """Words one by one: a leaf ends after LEAF words or a word that ends in a mark."""
    out = []
    for section in text.split("\n\n"):
        lines = section.split("\n")
        sec = []
        for k, line in enumerate(lines):
            leaves, now, words = [], "", 0
            for piece in re.findall(r"[^ \t\x0b\f\r]{1,96}[ \t\x0b\f\r]*|[ \t\x0b\f\r]+", line):
                now, words = now + piece, words + 1
                if words == fingerprints.LEAF or re.search(r"[.,;:!?]\s*$", piece) or not re.search(r"\s$", piece) or not piece.strip():
                    leaves.append(now)
                    now, words = "", 0
            sec.append(leaves + ([now] if now else []) + ["\n\n" if k + 1 == len(lines) else "\n"])
        out.append(sec)
    return out


def plain_root(text):
    return sha("|".join(sha("/".join(sha(".".join(map(sha, p))) for p in s)) for s in plain_leaves(text)))


def plain_near(a, b):
    x, y = (Counter(leaf for s in plain_leaves(t) for p in s for leaf in p) for t in (a, b))
    size = lambda c: sum(len(k) * n for k, n in c.items())
    return size(x & y) / size(x | y)


def corpus():
    r = random.Random(6)
    word = lambda: r.choice(["alpha", "beta", "gamma,", "delta.", "é", "x" * 200, "end!", "two  blanks", "tab\there"])
    text = lambda: "".join(word() + r.choice([" ", " ", " ", "\n", "\n\n", "\n\n\n"]) for _ in range(r.randrange(0, 60)))
    return [text() for _ in range(40)] + ["", "a\nb", "a\n\nb", "\n", "\n\n", "same words here. " * 30, "same words here. " * 30]


def test_roots_likeness_and_edits(docs_of):
    texts = corpus()
    got = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        after = texts[i - 1]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        assert got[i]["fingerprint"] == plain_root(t) and got[i]["edited_fingerprint"] == plain_root(edited), repr(t)
        assert got[i]["near_next"] == pytest.approx(plain_near(t, after)) and got[i]["near_edited"] == pytest.approx(plain_near(t, edited))
        a, b = got[i]["edit_start"], got[i]["edit_end"]
        if edited == t:
            assert a == b
        else:  # all that differs lies between the located leaves
            assert t[:a] == edited[:a] and t[b:] == edited[len(edited) - (len(t) - b) :]
    assert got[45]["near_next"] != 1 and got[46]["near_next"] == 1


def test_an_inserted_word_changes_its_sentence_only(spark):
    a = "One short sentence. " * 40 + "here it is. " + "Another short sentence. " * 40
    b = a.replace("here it is", "here it really is")
    d = spark.createDataFrame([(a, b)], "a string, b string")
    r = fingerprints.compare(fingerprints.tree(fingerprints.tree(d, "a", "x_"), "b", "y_"), "x_", "y_").first()
    assert a[r["edit_start"] : r["edit_end"]] == "here it is. " and len(r["differ_a"]) == len(r["differ_b"]) == 1 and r["near"] > 0.98


@pytest.mark.parametrize("rows", [fingerprints.RANGE_ROWS, 1])
def test_next_in_many_ranges(spark, rows):
    ids = random.Random(1).sample(range(-10**6, 10**6), 3000)
    d = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    got = {r["id"]: r["next_text"] for r in fingerprints.with_next(d, rows).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1])}
