"""Suffix order, nearest smaller positions and longest previous factors against brute force."""

import numpy as np
import pytest

suffix_dedup = pytest.importorskip("vitalspark.llm.suffix_dedup")
LENGTH = suffix_dedup.LENGTH


def strings(r, n):
    base = r.integers(97, 100, 150).astype(np.uint8)
    out = []
    for _ in range(n):
        x = base.copy()
        for k in r.integers(0, 150, r.integers(0, 3)):
            x[k] = 120 + r.integers(0, 3)
        out.append(x[r.integers(0, 40) : 150 - r.integers(0, 10)])
    return out


def plain_factors(raw, places):
    out = []
    for k, p in enumerate(places):
        best = 0
        for q in places[:k]:
            n = 0
            while n < LENGTH and raw[p + n] == raw[q + n]:
                n += 1
            best = max(best, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_longest_previous_factors(seed):
    r = np.random.default_rng(seed)
    parts = strings(r, 7) + [np.full(180, 97, np.uint8), np.tile(np.array([97, 98], np.uint8), 70)]
    sizes = np.array([len(x) for x in parts])
    data, first = np.concatenate(parts), np.cumsum(sizes) - sizes
    places = np.concatenate([a + np.arange(n - LENGTH + 1) for a, n in zip(first, sizes)])
    raw = data.tobytes()
    suffixes = suffix_dedup.Suffixes(data, places)
    assert [raw[places[k] : places[k] + LENGTH] for k in suffixes.order()] == sorted(raw[p : p + LENGTH] for p in places)
    assert suffix_dedup.longest_previous_factors(data, places).tolist() == plain_factors(raw, places.tolist())


@pytest.mark.parametrize("rounds", [0, 2, 64])
def test_previous_smaller(rounds):
    r = np.random.default_rng(3)
    for x in (r.permutation(500), np.arange(300), np.arange(300)[::-1], np.concatenate([np.arange(1, 200), [0]]), np.zeros(0, np.int64)):
        want = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert suffix_dedup.previous_smaller(x, rounds).tolist() == want


def test_frequent_anchors_are_dealt_anew(docs_of):
    """One passage in many contexts, and one byte many times over: groups beyond the bound, and halves beyond it."""
    import test_operators

    r = np.random.default_rng(5)
    word = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    core, side = word(80), [word(40) for _ in range(3)]
    texts = [word(60) + core + word(60) for _ in range(12)] + [
        word(50) + side[k % 3] + core + side[k % 2] + word(50) for k in range(12)
    ] + ["z" * 400, "z" * 250 + core]
    for group in (1, 3):
        out = suffix_dedup.remove_repeats(docs_of(texts), group=group).collect()
        got = {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"])) for x in out}
        assert got == {i: x[:3] for i, x in test_operators.plain_repeats(dict(enumerate(texts))).items()}


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5, 6], [0, 2, 1, 3, 6, 5, 4]])
@pytest.mark.parametrize("partitions", [1, 3])
def test_repeated_ids(docs_of, order, partitions):
    """Rows of one id with other texts are documents by the SHA-256 of their texts; rows equal in id and text are one document."""
    import hashlib

    import test_operators

    r = np.random.default_rng(9)
    a, y = ("".join(map(chr, r.integers(97, 123, n))) for n in (300, 40))
    rows = [(0, a), (1, "x" + a + y), (1, "short"), (2, a[100:] + y), (1, "x" + a + y), (3, None), (None, a)]
    documents = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda d: (d[0], hashlib.sha256(d[1].encode()).hexdigest()))
    want = test_operators.plain_repeats({k: t for k, (_, t) in enumerate(documents)})
    given = [rows[k] for k in order]
    out = suffix_dedup.op6_suffix_dedup(docs_of([t for _, t in given], ids=[i for i, _ in given]).repartition(partitions)).collect()
    expected = [(i, *want[documents.index((i, t or ""))][:3]) if i is not None else (None, len(t), 0, 0) for i, t in rows]
    assert sorted(((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"]) for x in out), key=repr) == sorted(expected, key=repr)
