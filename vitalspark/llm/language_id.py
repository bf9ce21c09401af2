"""Language identification of mixed-language texts.

Learning (Spark): letters-only words of a bounded sample of labelled documents (``SAMPLE`` documents a language in expectation) are counted by
language, as words, as character trigrams and by script; the ``TOP_WORDS`` words and ``TOP_GRAMS`` trigrams that are most frequent within some
language make the model. All three bounds are parameters, and so is the size of what is broadcast.

Prediction: the script of a word narrows the languages; each word has a log-probability score for every language left; Viterbi with a
price for each switch labels the words, and runs of equal labels are the spans. The language with the most letters wins; its share of the
letters is the score. Texts in which no switch can pay are labelled at once (``one_language``), which gives the labels of Viterbi.

A letter is a character of Unicode category L. A text that is null or has no letter is ``und`` with score 0. Ties go to the first
language by name. Languages are learnt only from rows with text and label.
With nothing to learn from, every text is ``und``. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

SAMPLE, TOP_WORDS, TOP_GRAMS = 2_000, 30_000, 20_000
#: Price of a change of language between words, and the most that one word may speak for a language.
SWITCH, CLIP = 8.0, 6.0
#: Bytes of text that a task labels together.
TOGETHER = 1 << 20
UND = "und"
#: Runs of letters and of numerals that are no digits.
_RUN = re.compile(r"[^\W\d_]+")
#: First code points of the script ranges told apart; a fixed table of Unicode blocks.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "lao"),
    (0x0F00, "tibetan"),
    (0x1000, "myanmar"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x13A0, "other"),
    (0x1780, "khmer"),
    (0x1800, "mongolian"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2E80, "han"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB1D, "hebrew"),
    (0xFB50, "arabic"),
    (0xFE00, "other"),
    (0x20000, "han"),
)
_FIRST = np.array([a for a, _ in SCRIPTS])
_NAMES = [b for _, b in SCRIPTS]


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L)."""
    found = _RUN.findall(text)
    if not found or "".join(found).isalpha():
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def script(word: str) -> str:
    return _NAMES[int(np.searchsorted(_FIRST, ord(word[0]), "right")) - 1]


def grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def learn(labelled: DataFrame, sample: int = SAMPLE, top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS) -> "Model":
    """``labelled``: text and lang, both non-null. Other columns only deal rows in or out of the sample, so that copies of a text are told apart."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in bt.slices(batches, 0, 16 * TOGETHER):
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text.lower()))
            found: Counter = Counter()
            for lang, of in words.items():
                for w, n in of.items():
                    found[lang, "w", w] += n
                    found[lang, "s", script(w)] += n
                    for g in grams(w):
                        found[lang, "g", g] += n
            rows = list(found.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[x] for k, _ in rows], pa.string()) for x in range(3)] + [pa.array([n for _, n in rows], pa.int64())],
                ["lang", "kind", "feature", "n"],
            )

    def number(of: dict) -> F.Column:
        return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])

    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return Model({}, {}, {}, {})
    share = number({lang: min(1.0, sample / n) * (1 << 20) for lang, n in sizes.items()})
    bounded = labelled.where(F.pmod(F.xxhash64(*labelled.columns, F.lit(7)), F.lit(1 << 20)) < share[F.col("lang")])
    counts = bounded.select("text", "lang").mapInArrow(
        count, "lang string, kind string, feature string, n long"
    ).groupBy("lang", "kind", "feature").agg(F.sum("n").alias("n")).persist()
    totals = {(r["lang"], r["kind"]): r["n"] for r in counts.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect()}

    def top(kind: str, most: int) -> dict[str, dict[str, int]]:
        of = {lang: n for (lang, k), n in totals.items() if k == kind}
        if not of:
            return {}
        share = F.col("n") / number(of)[F.col("lang")]
        by = counts.where(F.col("kind") == kind).groupBy("feature").agg(
            F.max(share).alias("share"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
        )
        return {r["feature"]: r["by"] for r in by.orderBy(F.desc("share"), "feature").limit(most).collect()}

    model = Model(totals, top("w", top_words), top("g", top_grams), top("s", 64))
    counts.unpersist()
    return model


class Model:
    """Scores in arrays: a row a word or trigram, a column a language."""

    def __init__(self, totals: dict, words: dict, trigrams: dict, scripts: dict):
        self.langs = sorted({lang for lang, _ in totals})
        self.words = {w: k for k, w in enumerate(words)}
        self.word_scores = self._scores(totals, words, "w", 0.5)
        codes = np.array([(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in trigrams], np.int64)
        order = np.argsort(codes)
        self.grams = codes[order]
        unseen = [-np.log(totals.get((x, "g"), 0) + 0.5 * (len(trigrams) + 1)) + np.log(0.5) for x in self.langs]
        #: The last row is that of a trigram not seen.
        self.gram_scores = np.concatenate(
            [self._scores(totals, trigrams, "g", 0.5)[order], np.array([unseen], np.float32)]
        ) if self.langs else np.zeros((1, 0), np.float32)
        #: A language is a candidate for a script that makes up at least a thousandth of its words; a script that no language has narrows nothing.
        self.allowed = np.ones((len(SCRIPTS), len(self.langs)), bool)
        for k, s in enumerate(_NAMES):
            of = np.array([scripts.get(s, {}).get(x, 0) * 1000 >= totals.get((x, "s"), 1) for x in self.langs], bool)
            if of.any():
                self.allowed[k] = of

    def _scores(self, totals: dict, features: dict, kind: str, plus: float) -> np.ndarray:
        base = np.array([totals.get((x, kind), 0) + plus * (len(features) + 1) for x in self.langs])
        n = np.array([[by.get(x, 0) for x in self.langs] for by in features.values()], np.float64).reshape(len(features), len(self.langs))
        return np.log((n + plus) / base).astype(np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log score of each word for each language, relative to the best, at least -CLIP; languages of another script lie at -CLIP."""
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        out = np.zeros((len(words), len(self.langs)), np.float64)
        known, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out[known] = self.word_scores[at[known]]
        chars = np.frombuffer("".join(f"^{words[k]}$" for k in new).encode("utf-32-le"), np.uint32).astype(np.int64)
        if len(new):
            size = np.fromiter((len(words[k]) for k in new), np.int64, len(new))  # as many trigrams as letters
            first = np.concatenate([[0], np.cumsum(size + 2)])[:-1]
            place = np.repeat(first, size) + bt.ranges(size)
            code = (chars[place] << 42) | (chars[place + 1] << 21) | chars[place + 2]
            k = np.searchsorted(self.grams, code)
            row = np.where((k < len(self.grams)) & (np.append(self.grams, -1)[k] == code), k, len(self.grams))
            out[new] = np.add.reduceat(self.gram_scores[row].astype(np.float64), np.cumsum(size) - size)
        letter = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
        out[~self.allowed[np.searchsorted(_FIRST, letter, "right") - 1]] = -np.inf
        return np.maximum(out - out.max(axis=1, keepdims=True), -CLIP)


def viterbi(scores: np.ndarray, first: np.ndarray, price: float) -> np.ndarray:
    """Labels of the words of many texts at once: step t handles the t-th word of every text that has one."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(1, longest + 1), "right")
    labels = np.zeros(len(scores), np.int32)
    if not longest:
        return labels
    back = []
    here = np.arange(scores.shape[1], dtype=np.int32)
    v = scores[start[: live[0]]].astype(np.float64)
    last = np.zeros(len(n), np.int32)
    for t in range(1, longest + 1):
        m = live[t] if t < longest else 0
        if m < len(v):
            last[m : len(v)] = v[m:].argmax(axis=1)
        if not m:
            break
        v = v[:m]
        best = v.max(axis=1, keepdims=True) - price
        stay = v >= best
        back.append(None if stay.all() else np.where(stay, here, v.argmax(axis=1)[:, None].astype(np.int32)))
        v = np.maximum(v, best) + scores[start[:m] + t]
    now = last.copy()
    for t in range(longest - 1, -1, -1):
        m = live[t]
        labels[start[:m] + t] = now[:m]
        if t and (b := back[t - 1]) is not None:
            now[:m] = b[np.arange(m), now[:m]]
    return labels


def one_language(scores: np.ndarray, first: np.ndarray, price: float) -> np.ndarray:
    """For each text the language that Viterbi gives all its words, -1 where this short proof doesn't tell. Texts without words give -1.

    Let L have the largest sum, and d be another language's score less L's, word by word. A path that leaves L pays a switch for each stretch of
    another language at least, and such a stretch gains at most the largest sum of d over a stretch. A path without L starts with a gain of at
    most the largest sum over a beginning and ends with that over an end. If no stretch gains more than the price, nor beginning and end together,
    no path beats L throughout."""
    out = np.full(len(first) - 1, -1, np.int64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    begin, end = first[full], first[full + 1]
    total = np.add.reduceat(scores, begin)
    best = total.argmax(axis=1)
    own = np.repeat(np.arange(len(full)), end - begin)
    base = scores[np.arange(len(scores)), best[own]]
    stretch, prefix, suffix = (np.zeros(len(full)) for _ in range(3))
    apart = own * (2.0 * CLIP * int((end - begin).max()) + 1)  # texts lie one below the other, so that running minima don't cross them
    for k in range(scores.shape[1]):
        d = scores[:, k] - base
        run = np.cumsum(d)
        before = run - d
        start = before[begin]
        run, before = run - start[own], before - start[own]
        prefix = np.maximum(prefix, np.maximum.reduceat(run, begin))
        suffix = np.maximum(suffix, run[end - 1] - np.minimum.reduceat(before, begin))
        low = np.minimum.accumulate(before - apart) + apart
        stretch = np.maximum(stretch, np.maximum.reduceat(run - low, begin))
    sure = (stretch <= price) & (prefix + suffix <= price)
    out[full[sure]] = best[sure]
    return out


class Labeller:
    """Labels texts; the distinct words of the texts given together are scored once."""

    def __init__(self, model: Model):
        self.model = model

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each text, label and number of letters of each word."""
        found = [words_of(x.lower()) if x else [] for x in texts]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        first = np.concatenate([[0], np.cumsum(counts)])
        every = list(chain.from_iterable(found))
        words = list(dict.fromkeys(every))
        at = dict(zip(words, range(len(words)), strict=True))
        which = np.fromiter(map(at.__getitem__, every), np.int64, len(every))
        if not len(which):
            return first, np.zeros(0, np.int64), which
        scores = self.model.scores(words)[which]
        lang = one_language(scores, first, SWITCH)
        labels = np.repeat(lang, counts)
        open_ = np.flatnonzero(labels < 0)
        if len(open_):
            labels[open_] = viterbi(scores[open_], np.concatenate([[0], np.cumsum(counts[lang < 0])]), SWITCH)
        return first, labels, np.fromiter(map(len, words), np.int64, len(words))[which]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        if not langs:
            return [UND] * len(texts), [0.0] * len(texts)
        first, labels, letters = self.label(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        by = np.bincount(row * len(langs) + labels, letters, len(texts) * len(langs)).reshape(len(texts), -1)
        total, best = by.sum(axis=1), by.argmax(axis=1)
        top = by[np.arange(len(texts)), best]
        return [langs[b] if t else UND for b, t in zip(best, total, strict=True)], [
            float(x / t) if t else 0.0 for x, t in zip(top, total, strict=True)
        ]


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", together: int = TOGETHER) -> DataFrame:
    """(id, lang_pred, score) of every row's whole text."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(cast.value)
        for part in bt.slices(batches, 1, together):
            lang, score = labeller.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"]
            )

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    return docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text")
    ).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def language_spans(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", together: int = TOGETHER
) -> DataFrame:
    """(id, spans): runs of words of one language, as (lang, first word, words) of the letters-only words."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(cast.value)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("words", pa.int64())]))
        for part in bt.slices(batches, 1, together):
            texts = part.column(1).to_pylist() if labeller.model.langs else [None] * part.num_rows
            first, labels, _ = labeller.label(texts)
            spans = []
            for a, b in zip(first[:-1], first[1:], strict=True):
                cuts = np.concatenate([[a], a + 1 + np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1]), [b]]) if b > a else []
                spans.append(
                    [
                        {"lang": labeller.model.langs[labels[x]], "first": int(x - a), "words": int(y - x)}
                        for x, y in zip(cuts[:-1], cuts[1:], strict=True)
                    ]
                )
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["id", "spans"])

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    spans = "array<struct<lang:string,first:long,words:long>>"
    return docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text")
    ).mapInArrow(run, f"id {kind}, spans {spans}").withColumnRenamed("id", id_column)


def held_out(id_column: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_column).cast("string")) % 5 == 0


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows that are not held out; the id only deals rows to the sample. A row without an id is not learnt from."""
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", "doc_id")


def op5_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(training_rows(docs))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang", together: int = TOGETHER
) -> DataFrame:
    """The documents whose language is known: not ``und``. A null label is
    filled with the prediction. All columns stay; the texts are read once and not shuffled."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    at, to = docs.columns.index(text_column), docs.columns.index(lang_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(cast.value)
        for part in bt.slices(batches, at, together):
            lang, _ = labeller.predict(part.column(at).to_pylist())
            label = [x if x is not None else y for x, y in zip(part.column(to).to_pylist(), lang, strict=True)]
            part = part.set_column(to, part.schema.field(to), pa.array(label, part.schema.field(to).type))
            yield part.filter(pa.array([x != UND for x in lang], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
