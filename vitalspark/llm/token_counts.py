"""Token counts under a SentencePiece vocabulary, with a whole-token shortcut.

The text is cut where no vocabulary piece can span: before a whitespace marker that follows another
character, and around line feeds. Each pre-token is then counted on its own. Which vocabulary strings encode
alone as one token is proved once, by encoding every one of them; a pre-token in that set counts 1 without any
merging, and only the others are merged by the library (distinct ones, remembered up to ``CACHE`` entries of ``CACHE_CHARACTERS`` together).

Null and empty texts have 0 tokens. Repeated rows are counted each. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

MARK = "▁"
#: Pre-tokens remembered by a worker; memory only, never a limit on what is counted.
CACHE, CACHE_CHARACTERS = 200_000, 4 << 20


class Counter:
    """Counts tokens of texts exactly as ``SentencePieceProcessor.encode`` yields them."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(self.model.get_piece_size())
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i)
        plain = [self.model.id_to_piece(i) for i in ids if not special(i)]
        #: Pre-tokens are independent if no piece has a marker after another character, and the text is only
        #: changed by marking blanks, with one marker put in front.
        self.splits = not any(MARK in p.lstrip(MARK) for p in plain) and [MARK + "a", MARK + MARK + "b"] == self._cut_probe()
        self.line_feed = 0
        if self.splits and not any("\n" in p for p in plain):
            self.line_feed = len(self.model.encode("a\n\nb")) - len(self.model.encode("a\nb"))
            if len(self.model.encode("a\nb")) != len(self.model.encode("a")) + self.line_feed + self._bare("b"):
                self.line_feed = 0
        self.base = self.whole_tokens(plain) | {"": 1}  # "": a marker alone, at the end of a text
        self.known = dict(self.base)
        self.held = 0

    def _cut_probe(self) -> list[str]:
        """What the normaliser makes of blanks, read from the pieces of a probe."""
        joined = "".join(self.model.encode("a  b", out_type=str))
        return [MARK + "a", joined[2:]] if joined.startswith(MARK + "a") else []

    def _bare(self, s: str) -> int:
        """Tokens of a string that no marker precedes."""
        return len(self.model.encode("\n" + s)) - len(self.model.encode("\n"))

    def whole_tokens(self, plain: list[str]) -> dict[str, int]:
        """The vocabulary strings of the form marker + text that encode alone as one token, as pre-tokens of a text."""
        asked = [p[1:] for p in plain if p.startswith(MARK) and p != MARK and not p[1:].startswith(MARK)]
        return {x: 1 for x, ids in zip(asked, self.model.encode(asked), strict=True) if len(ids) == 1}

    def _learn(self, fresh: list[str]) -> None:
        self.held += sum(map(len, fresh))
        self.known.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.splits:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self.known) > CACHE + len(self.base) or self.held > CACHE_CHARACTERS:
            self.known, self.held = dict(self.base), 0
        cut, out = re.compile(" *[^ ]+| +").findall, []
        parts, tails = [], []
        for text in texts:
            if MARK in text:
                text = text.replace(MARK, " ")
            if text and text[0] == " ":  # the marker put in front stands before the first blank
                text = " " + text
            if "  " in text or text.endswith(" "):
                found = [x[1:] if x[0] == " " else x for x in cut(text)]
            else:
                found = text.split(" ")[bool(text.startswith(" ")) :] if text else []
            tail = []
            if self.line_feed and "\n" in text:
                head = []
                for x in found:
                    if "\n" in x:
                        first, *others = x.split("\n")
                        n = len(others) * self.line_feed
                        if first:
                            head.append(first)
                        else:
                            n += 1  # the marker alone
                        tail += ["\n" + y for y in others if y]
                        tail.append(n)
                    else:
                        head.append(x)
                found = head
            parts.append(found)
            tails.append(tail)
        fresh = {x for p in parts for x in p}.union(x for t in tails for x in t if isinstance(x, str)).difference(self.known)
        if fresh:
            self._learn(list(fresh))
        known = self.known
        lead = len(self.model.encode("\n")) if self.line_feed else 0
        for p, t in zip(parts, tails, strict=True):
            n = sum(map(known.__getitem__, p))
            for x in t:
                n += x if isinstance(x, int) else known[x] - lead
            out.append(n)
        return out


@lru_cache(maxsize=1)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def token_counts(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", together: int = 1 << 20
) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text. ``model_file`` must be readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_file)
        for part in bt.slices(batches, 1, together):
            texts = [x or "" for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(c.count(texts), pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    size: Column = F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long")
    out = docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), size.alias("n_bytes")
    ).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.withColumnRenamed("id", id_column)


def op2_token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    return token_counts(docs, model_file).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
