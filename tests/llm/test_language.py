"""Language identification against plain Viterbi, script and span references."""

import numpy as np
import pytest

language_id = pytest.importorskip("vitalspark.llm.language_id")


def plain_viterbi(scores, price):
    """The best sum over all paths, word by word."""
    v = scores[0].copy()
    for row in scores[1:]:
        v = np.array([max(v[j] - (price if j != k else 0) for j in range(len(v))) for k in range(len(v))]) + row
    return v.max()


def path_sum(scores, path, price):
    return sum(scores[t, k] for t, k in enumerate(path)) - price * sum(a != b for a, b in zip(path[:-1], path[1:]))


def test_viterbi_and_the_short_proof():
    r = np.random.default_rng(0)
    told = 0
    for _ in range(200):
        sizes = r.integers(0, 40, 5)
        first = np.concatenate([[0], np.cumsum(sizes)])
        scores = -6 * r.random((int(first[-1]), 4)) * (r.random((int(first[-1]), 4)) < 0.8)
        for a, b, lang in zip(first[:-1], first[1:], r.integers(0, 4, 5)):
            scores[a:b, lang] *= r.choice([0.1, 0.5])
        if not len(scores):
            continue
        scores -= scores.max(axis=1, keepdims=True)
        labels, one = language_id.viterbi(scores, first, 8.0), language_id.one_language(scores, first, 8.0)
        for a, b, lang in zip(first[:-1], first[1:], one):
            if b > a:
                best = plain_viterbi(scores[a:b], 8.0)
                assert path_sum(scores[a:b], labels[a:b], 8.0) == pytest.approx(best)
                if lang >= 0:
                    told += 1
                    assert path_sum(scores[a:b], [lang] * (b - a), 8.0) == pytest.approx(best)
    assert told > 300


def test_scores_of_words_equal_plain_sums():
    totals = {("en", "w"): 10, ("ru", "w"): 6, ("en", "g"): 40, ("ru", "g"): 30, ("en", "s"): 10, ("ru", "s"): 6}
    trigrams = {"^ab": {"en": 3}, "bc$": {"en": 2, "ru": 1}, "^да": {"ru": 5}}
    m = language_id.Model(totals, {"the": {"en": 4}, "да": {"ru": 4}}, trigrams, {"latin": {"en": 10, "ru": 0}, "cyrillic": {"ru": 6}})
    unseen = [np.log(0.5 / (totals[x, "g"] + 2)) for x in ("en", "ru")]
    gram = lambda g, k, x: np.log((trigrams[g].get(x, 0) + 0.5) / (totals[x, "g"] + 2)) if g in trigrams else unseen[k]
    for word, script in (("abc", 0), ("xbc", 0), ("дам", 1), ("the", 0)):
        got = m.scores([word])[0]
        assert got[script] == 0 and got[1 - script] == -language_id.CLIP  # the other language's script is another
    free = language_id.Model(totals, {}, trigrams, {})
    for word in ("abc", "xbc", "q", "дабc"):
        sums = np.array([sum(gram(g, k, x) for g in language_id.grams(word)) for k, x in enumerate(("en", "ru"))])
        assert free.scores([word])[0] == pytest.approx(np.maximum(sums - sums.max(), -language_id.CLIP), abs=1e-5)


def test_numerals_are_no_letters(docs_of):
    texts = ["some plain english words here"] * 12 + ["½ ² Ⅷ", "¼ tasse", None, ""]
    langs = ["en"] * 12 + [None] * 4
    got = {r["doc_id"]: r for r in language_id.op5_language_id(docs_of(texts, langs)).collect()}
    assert [got[k]["lang_pred"] for k in (12, 13, 14, 15)] == ["und", "en", "und", "und"]
    assert got[12]["score"] == 0 and language_id.words_of("a½b 五 x1²y") == ["a", "b", "五", "x", "y"]


def test_two_hundred_languages(docs_of):
    word = lambda k: "".join(chr(97 + (k // 26**i) % 26) for i in range(2)) + "xyz"
    texts = [f"{word(k)} {word(k)}q {word(k)}qq" for k in range(200) for _ in range(4)]
    langs = [f"l{k:03d}" for k in range(200) for _ in range(4)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.op5_language_id(docs_of(texts, langs)).collect()}
    assert sum(got[i] == lang for i, lang in enumerate(langs)) > 0.95 * len(langs)


def test_a_rare_language_is_learnt_beside_a_frequent_one(docs_of):
    texts = ["the house and water with people"] * 3000 + [f"das haus und wasser mit leuten {k}" for k in range(8)]
    langs = ["en"] * 3000 + ["de"] * 8
    d = docs_of(texts, langs)
    model = language_id.learn(language_id.training_rows(d), sample=200)
    assert model.langs == ["de", "en"]
    assert language_id.Labeller(model).predict(["wasser und haus"])[0] == ["de"]


def test_spans_against_a_plain_walk(docs_of):
    d = docs_of(["the house and water with people " * 4, "das haus und wasser mit leuten " * 4] * 6, ["en", "de"] * 6)
    model = language_id.learn(language_id.training_rows(d))
    text = "the house and water " * 8 + "das haus mit leuten und " * 8 + "with people " * 8
    spans = language_id.language_spans(docs_of([text, None, "12"]), model).collect()
    by = {r["doc_id"]: [(s["lang"], s["first"], s["words"]) for s in r["spans"]] for r in spans}
    assert by == {0: [("en", 0, 32), ("de", 32, 40), ("en", 72, 16)], 1: [], 2: []}
