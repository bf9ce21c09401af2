"""Vector codes against a plain product quantiser, with ties, repeated rows and rows that are dropped."""

import hashlib
import math
import random

import numpy as np
import pytest

vector_codes = pytest.importorskip("vitalspark.llm.vector_codes")
from vitalspark.llm.scratch import Scratch  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, vector string"
NAN, INF = float("nan"), float("inf")


def plain(rows, parts, entries, rounds):
    """(id, label, code, error) in whole numbers, and the codebooks."""
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fit = [r for r in good if len(r[1]) % parts == 0]
    if not fit:
        return [], []
    good = [r for r in good if len(r[1]) == len(fit[0][1])]
    width = len(fit[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in good]
    books = [[list(cut[e][p]) for e in range(min(entries, len(good)))] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut:
                groups.setdefault(nearest(x[p], books[p])[1], []).append(x[p])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for (i, _, lab), x in zip(good, cut):
        got = [nearest(x[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in got), sum(d for d, _ in got)))
    return out, books


def made(n, dims, seed, grid):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.randrange(-grid, grid) / 64)) for _ in range(dims)], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("n,dims,parts,entries,rounds,groups,grid", [(300, 8, 4, 16, 2, 4, 4), (200, 6, 2, 8, 6, 3, 40), (5, 4, 2, 64, 2, 4, 9), (90, 4, 1, 7, 3, 1, 2), (60, 4, 4, 64, 2, 64, 3)])
def test_as_plain(spark, n, dims, parts, entries, rounds, groups, grid):
    rows = made(n, dims, n, grid)
    rows += [rows[0], rows[1], (3, rows[2][1], 1), (None, rows[4][1], None)]  # repeated rows, a repeated id, no id
    rows += [(900, None, 1), (901, [], 1), (902, [NAN] * dims, 1), (903, [INF] + [0.0] * (dims - 1), 1), (904, [None] * dims, 1), (905, [0.5] * (dims + 1), 1)]
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df, Scratch(spark, "t"), parts=parts, entries=entries, rounds=rounds, groups=groups)
    want, books = plain(rows, parts, entries, rounds)
    have = [(r["vec_id"], r["label"], r["code"], r["error"]) for r in got.rows.collect()]
    assert sorted(map(repr, have)) == sorted(map(repr, want))
    assert got.codebooks.tolist() == books
    assert vector_codes.codebooks_sha256(got.codebooks) == hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def test_bounds_spare_work(spark):
    """In clusters that hardly move, most groups are never measured again, and the codes are those of full scans all the same."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (16, 8))
    rows = [(i, (centres[i % 16] + rng.normal(0, 0.02, 8)).astype(np.float32).tolist(), 0) for i in range(800)]
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), Scratch(spark, "t"), parts=2, entries=16, rounds=3, groups=4)
    want, _ = plain(rows, 2, 16, 3)
    assert sorted((r["vec_id"], r["label"], r["code"], r["error"]) for r in got.rows.collect()) == sorted(want)
    assert got.rows.agg({"rescans": "sum"}).first()[0] < 0.3 * 800 * 2 * 4 * 3


def test_net_displacement_is_tighter_than_drift():
    """A codebook that goes out and comes back has moved nowhere: the old bound holds in full, where added drifts would give it up."""
    there = np.array([[[0, 0], [1000, 0]]])
    away = np.array([[[400, 0], [1400, 0]]])
    assign = vector_codes.Assigner([there, away, there], 2)
    assert assign.moved[0].tolist() == [[0.0, 0.0]] and assign.moved[1].tolist() == [[400.0, 400.0]]
    x = np.array([[10, 0]])
    _, _, opened = assign.again(x, 0, np.array([0]), np.array([[np.inf, 989.0]], np.float32), np.zeros((1, 2), np.uint8))
    assert opened.tolist() == [0]
    _, _, opened = assign.again(x, 0, np.array([0]), np.array([[np.inf, 989.0 - 800 - 200]], np.float32), np.zeros((1, 2), np.uint8))
    assert opened.tolist() == [1]


def test_large_components(spark):
    rows = [(0, [1e9, 2.0], 1), (1, [-3e30, 2.5], 1), (2, [1e9, 2.25], None)]
    df = spark.createDataFrame(rows[:1] + rows[2:], "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(df, Scratch(spark, "t"), parts=2, entries=1, rounds=2)
    want, _ = plain([(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows[:1] + rows[2:]], 2, 1, 2)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.rows.collect()) == sorted((i, c, e) for i, _, c, e in want)
    assert vector_codes.whole(np.array([-3e30, 0.5])).tolist() == [int(-3e30) * 256, 128]


def test_query_labels_and_empty(spark):
    rows = made(70, 32, 1, 30)
    got = vector_codes.op11_vector_codes(spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)).collect()
    want, books = plain(rows, 16, 64, 2)
    sums = {}
    for _, lab, _, e in want:
        sums[lab] = sums.get(lab, 0) + e
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == sorted((i, c, e, sums[lab]) for i, lab, c, e in want)
    assert len({r["codebooks_sha256"] for r in got}) == 1
    for rows in ([], [(1, None, 1, "x", 1, "y")], [(1, [1.0], 1, "x", 1, "y")]):
        assert vector_codes.op11_vector_codes(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_decompress(spark):
    rows = made(80, 8, 2, 30)
    got = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), Scratch(spark, "t"), parts=4, entries=16)
    for r in vector_codes.decompress(got.rows, got.codebooks).collect():
        whole = [math.floor(256 * x) for x in rows[r["vec_id"]][1]]
        assert sum((a - b * 256) ** 2 for a, b in zip(whole, r["approximation"])) == r["error"]
