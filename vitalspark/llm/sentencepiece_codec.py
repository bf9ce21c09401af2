"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A model file gives pieces, kinds and scores. Scores of a unigram model are used as they are. The scores of a BPE model
are minus the merge ranks, not log probabilities; ``log_scores`` turns a rank r into -log(r + 2) - log(H), H the sum of 1/(r + 2): the
log probability of Zipf's law.

Encoding: blanks become the whitespace marker and one marker is put in front of a non-empty text. Among all segmentations into pieces
that with the highest score sum is taken; equal sums go to the one whose last differing piece is longer. A character that no
single-character piece covers may stand for itself at the lowest score minus 10, and is then written as its UTF-8 byte pieces, or as the
unknown piece if the model has none. Where no piece has a marker after another character the lattice falls apart before each
such marker: the parts are solved on their own, distinct ones together in arrays, and remembered.

Decoding: pieces' bytes are joined, markers become blanks, and the first marker goes. ``decode(encode(x)) == x`` unless x holds the marker character itself.

Null and empty texts have no pieces. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .bytetext import ranges

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Kinds of pieces in a model file; fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts, and their characters, that a task remembers.
CACHE, CACHE_CHARACTERS = 150_000, 4 << 20


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    #: Settings of the model's normaliser: a marker in front of a text, and runs of blanks made one.
    dummy_prefix: bool = True
    one_blank: bool = False


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffer message."""
    i, n = 0, len(raw)

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = raw[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[i : i + size]
            i += size


def load(raw: bytes) -> Vocabulary:
    """Reads a serialised model: field 1 a piece (1 text, 2 score, 3 kind), field 2 the trainer's settings (3 the model type), field 3 the normaliser's
    (2 character map, 3 marker in front, 4 runs of blanks made one, 5 blanks become markers). A model with a character map, or without markers, is refused."""
    v = Vocabulary([], [], [])
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, x in _fields(value):
                if k == 1:
                    piece = x.decode()
                elif k == 2:
                    score = float(np.frombuffer(x, "<f4")[0])
                elif k == 3:
                    kind = x
            v.pieces.append(piece)
            v.scores.append(score)
            v.kinds.append(kind)
        elif number == 2:
            v.model_type = next((x for k, x in _fields(value) if k == 3), UNIGRAM)
        elif number == 3:
            found = dict(_fields(value))
            if found.get(2) or not found.get(5, 1):
                raise ValueError("models with a character map or without whitespace markers are not supported")
            v.dummy_prefix, v.one_blank = bool(found.get(3, 1)), bool(found.get(4, 1))
    return v


def log_scores(v: Vocabulary) -> Vocabulary:
    if v.model_type != BPE:
        return v
    rank = -np.array(v.scores) + 2
    normal = np.array(v.kinds) == NORMAL
    h = np.log((1 / rank[normal]).sum())
    return replace(
        v, scores=[float(-np.log(r) - h) if ok else s for r, ok, s in zip(rank, normal, v.scores, strict=True)], model_type=UNIGRAM
    )


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie: the child of state s by byte b is t = base[s] + b where check[t] = s; value is -1 for none."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, x in zip(keys, values, strict=True):
        s = 0
        for b in key:
            t = children[s].get(b)
            if t is None:
                t = len(children)
                children[s][b] = t
                children.append({})
                value.append(-1)
            s = t
        value[s] = x
    free = np.ones(2 * len(children) + 4096, bool)
    free[0] = False
    base, check, out = np.zeros(len(free), np.int32), np.full(len(free), -1, np.int32), np.full(len(free), -1, np.int32)
    place, low, step, most = np.zeros(len(children), np.int64), 1, 1024, 0
    for s, kids in enumerate(children):
        at = place[s]
        out[at] = value[s]
        if not kids:
            continue
        codes = np.array(sorted(kids))
        while not free[low]:
            low += 1
        if len(codes) == 1 and low >= codes[0]:
            off = low - int(codes[0])
        else:  # the first place from which on all children fit, sought in steps near the end of what is filled
            t = max(low, int(codes[0]), most - 4 * step)
            while True:
                if t + step + 256 >= len(free):
                    more = len(free)
                    free = np.concatenate([free, np.ones(more, bool)])
                    base = np.concatenate([base, np.zeros(more, np.int32)])
                    check, out = (np.concatenate([x, np.full(more, -1, np.int32)]) for x in (check, out))
                fits = free[t : t + step].copy()
                for b in codes[1:] - codes[0]:
                    fits &= free[t + b : t + b + step]
                if fits.any():
                    off = t + int(fits.argmax()) - int(codes[0])
                    break
                t += step
        base[at] = off
        free[off + codes] = False
        check[off + codes] = at
        place[[kids[b] for b in codes]] = off + codes
        most = max(most, off + int(codes[-1]))
    return base, check, out


class Codec:
    """Arrays of a vocabulary that encode and decode; small enough to be sent to every executor (bounded by the vocabulary)."""

    def __init__(self, v: Vocabulary):
        v = log_scores(v)
        self.text = [
            bytes([int(p[1:-1], 16)]) if k == BYTE else (p.replace(MARK, " ").encode() if k in (NORMAL, USER_DEFINED, UNUSED) else b"")
            for p, k in zip(v.pieces, v.kinds, strict=True)
        ]
        own = [i for i, k in enumerate(v.kinds) if k in (NORMAL, USER_DEFINED)]
        self.base, self.check, self.value = double_array([v.pieces[i].encode() for i in own], own)
        self.scores = np.array(v.scores, np.float64)  # path sums over long texts need all digits
        normal = [v.scores[i] for i, k in enumerate(v.kinds) if k == NORMAL]
        self.unknown_score = (min(normal) if normal else 0.0) - UNKNOWN_PENALTY
        self.dummy_prefix, self.one_blank = v.dummy_prefix, v.one_blank
        self.unknown = next((i for i, k in enumerate(v.kinds) if k == UNKNOWN), 0)
        self.bytes = np.full(256, -1, np.int64)
        for i, k in enumerate(v.kinds):
            if k == BYTE:
                self.bytes[int(v.pieces[i][1:-1], 16)] = i
        self.splits = not any(MARK in v.pieces[i].lstrip(MARK) for i in own)

    def edges(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of every piece at a character of data[start:end] (spans in order); piece -1 is an unknown character."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        stop = np.repeat(end, np.searchsorted(lead, end) - np.searchsorted(lead, start))
        width = np.diff(np.append(lead, len(data)))
        state, at, limit, own = np.zeros(len(lead), np.int64), lead.copy(), stop, np.arange(len(lead))
        single = np.zeros(len(lead), bool)
        out = []
        while len(own):
            to = self.base[state].astype(np.int64) + data[at]
            ok = (to < len(self.check)) & (self.check[np.minimum(to, len(self.check) - 1)] == state)
            own, state, at, limit = own[ok], to[ok], at[ok] + 1, limit[ok]
            v = self.value[state]
            hit = v >= 0
            out.append((lead[own[hit]], at[hit], v[hit].astype(np.int64)))
            single[own[hit & (at == lead[own] + width[own])]] = True
            more = at < limit
            own, state, at, limit = own[more], state[more], at[more], limit[more]
        bare = np.flatnonzero(~single)
        out.append((lead[bare], lead[bare] + width[bare], np.full(len(bare), -1, np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of all parts one after the other, and how many each has. Each is solved on its own; none is empty."""
        sizes = np.array([len(x) for x in parts], np.int64)
        end = np.cumsum(sizes)
        start = end - sizes
        data = np.frombuffer(b"".join(parts), np.uint8)
        a, b, piece = self.edges(data, start, end)
        score = np.where(piece >= 0, self.scores[piece], self.unknown_score)
        part = np.searchsorted(end, a, "right")
        length = b - a
        # Step by the offset within the part, then by length: places reached in one step are distinct.
        order = np.argsort((a - start[part]) * (int(length.max()) + 1) + length, kind="stable")
        a, b, piece, score, length, offset = a[order], b[order], piece[order], score[order], length[order], (a - start[part])[order]
        best = np.full(len(data) + len(parts) + 1, -np.inf)
        via = np.full(len(best), -1, np.int64)
        shift = part[order]  # part k's places are k further, so that its end is no other's start
        a, b = a + shift, b + shift
        best[start + np.arange(len(parts))] = 0
        cut = np.concatenate(
            [[0], 1 + np.flatnonzero((offset[1:] != offset[:-1]) | (length[1:] != length[:-1])), [len(a)]]
        ) if len(a) else [0]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            t = b[x:y]
            s = best[a[x:y]] + score[x:y]
            up = s > best[t]
            if up.all():
                best[t] = s
                via[t] = np.arange(x, y)
            elif up.any():
                t = t[up]
                best[t] = s[up]
                via[t] = np.arange(x, y)[up]
        # Walk all parts back together.
        at = end + np.arange(len(parts))
        live = np.arange(len(parts))
        owner, found = [], []
        while len(live):
            e = via[at[live]]
            owner.append(live)
            found.append(e)
            at[live] = a[e]
            live = live[at[live] > start[live] + live]
        owner, found = np.concatenate(owner), np.concatenate(found)
        back = np.argsort(owner, kind="stable")
        owner, found = owner[back], found[back]
        n = np.bincount(owner, minlength=len(parts))
        firsts = np.cumsum(n) - n
        flat = found[firsts[owner] + n[owner] - 1 - (np.arange(len(owner)) - firsts[owner])]  # reversed within each part
        ids, spans = piece[flat], b[flat] - a[flat]
        if (ids < 0).any():
            wide = np.where(ids < 0, spans if self.bytes[0] >= 0 else 1, 1)
            at = np.repeat(a[flat] - shift[flat], wide) + ranges(wide)
            raw = self.bytes[data[np.minimum(at, len(data) - 1)]] if self.bytes[0] >= 0 else np.full(len(at), self.unknown)
            ids = np.where(np.repeat(ids < 0, wide), raw, np.repeat(ids, wide))
            n = np.bincount(np.repeat(owner, wide), minlength=len(parts))
        return ids.astype(np.int32), n

    def decode(self, ids: list[int] | np.ndarray) -> str:
        raw = b"".join([self.text[i] for i in ids])
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode(errors="replace")

    def normal(self, text: str) -> str:
        """The text as it is encoded, with blanks in place of markers and without the marker in front."""
        text = text.replace(MARK, " ")
        return re.sub(" +", " ", text).strip(" ") if self.one_blank else text


class Encoder:
    """Encodes texts with a codec; parts are remembered until there are ``CACHE`` of them or they hold ``CACHE_CHARACTERS``."""

    #: Bytes of parts solved together, and the longest part that is solved among others.
    TOGETHER, LONG = 1 << 20, 512

    def __init__(self, codec: Codec):
        self.codec = codec
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.held = 0
        self.flat = [np.zeros(0, np.int32)]
        self.sizes = [np.zeros(0, np.int64)]

    def _learn(self, fresh: list[str]) -> None:
        fresh = sorted(fresh, key=len)
        self.held += sum(map(len, fresh))
        group: list[str] = []
        held = 0
        for k, x in enumerate(fresh):
            group.append(x)
            held += len(x)
            if held > self.TOGETHER or k + 1 == len(fresh) or len(fresh[k + 1]) > self.LONG:
                ids, sizes = self.codec.segment([y.encode() for y in group])
                self.at.update(zip(group, range(len(self.at), len(self.at) + len(group)), strict=True))
                self.flat.append(ids)
                self.sizes.append(sizes)
                group, held = [], 0
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        self.firsts = np.cumsum(self.sizes[0]) - self.sizes[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All piece numbers, and where each text's begin (one more at the end)."""
        cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        if self.codec.one_blank:
            texts = [self.codec.normal(x) for x in texts]
        front = MARK if self.codec.dummy_prefix else ""
        marked = [front + x.replace(" ", MARK) if x else "" for x in texts]
        parts = [cut(x) for x in marked] if self.codec.splits else [[x] if x else [] for x in marked]
        if len(self.at) > CACHE or self.held > CACHE_CHARACTERS:
            self._reset()
        at = self.at
        flat = list(chain.from_iterable(parts))
        fresh = set(flat).difference(at)
        if fresh:
            self._learn(list(fresh))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        which = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
        if not len(which):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        n = self.sizes[0][which]
        ids = self.flat[0][np.repeat(self.firsts[which], n) + ranges(n)]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, ends


def encode_decode(
    docs: DataFrame, codec: Codec, id_column: str = "doc_id", text_column: str = "text", together: int = 1 << 20
) -> DataFrame:
    """(id, piece_ids, decoded, round_trip) of every row. ``round_trip``: decoding gives the text back, the marker read as a blank and, where
    the model makes runs of blanks one, so made."""
    cast = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cast.value)
        for part in bt.slices(batches, 1, together):
            texts = [x or "" for x in part.column(1).to_pylist()]
            ids, first = encoder.encode(texts)
            back = [encoder.codec.decode(ids[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
            same = [x == encoder.codec.normal(y) for x, y in zip(back, texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), lists, pa.array(back, pa.string()), pa.array(same, pa.bool_())],
                ["id", "piece_ids", "decoded", "round_trip"],
            )

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(
        run, f"id {kind}, piece_ids array<int>, decoded string, round_trip boolean"
    ).withColumnRenamed("id", id_column)


def op4_sentencepiece(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_pieces, piece_ids, decoded_sha256, round_trip of every document."""
    out = encode_decode(docs, Codec(load(model)))
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )
