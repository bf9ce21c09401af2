"""Secret scans: fixed patterns, and strings that a tokenizer can hardly compress.

Base kinds, leftmost and without overlap within a kind; a match that fails its length is dropped:
``assign`` (a named value), ``access`` (AKIA keys), ``hex`` (24 or more hex digits). The method adds ``random``:
a run of 20 or more key characters whose characters per token under a tiktoken vocabulary are below ``below``, or below ``LETTERS``
if it has no digit or is one word. Known digests (hex of the usual lengths), UUIDs, plain numbers and words joined with numbers
by ``_``, ``-``, ``/``, ``+`` or ``=`` are not taken as random, nor is a run that a base span already covers. In a run that is not random as a
whole (a key behind a readable path), the stretches between readable words and the single parts of 20 or more characters are tested likewise.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINT = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The longest run from a start is taken, so a run of fewer digits can hold no match of its own.
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hex.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIER = re.compile(r"(?:(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/=+-]+|$))+")

#: A part of a run that reads as a word or a short number, and what joins parts.
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}")
PART = re.compile(r"[A-Za-z0-9]+")
LEAST = 20
#: Characters per token below which a run without digits is random: words are known to the vocabulary, drawn letters are not.
LETTERS = 1.7

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINT):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Ratio:
    """Characters per token under a tiktoken rank file."""

    def __init__(self, ranks_file: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, s: str) -> float:
        return len(s) / len(self.encode(s))


def is_known(s: str) -> bool:
    """Digests, UUIDs, plain numbers and words joined with numbers: they name something, they open nothing."""
    if not any(c.isalpha() for c in s) or UUID.fullmatch(s) or (len(s) in DIGEST_LENGTHS and HEX_ONLY.fullmatch(s)):
        return True
    return any(c.isdigit() for c in s) and IDENTIFIER.fullmatch(s) is not None


def is_random(s: str, ratio: Ratio, below: float) -> bool:
    return len(s) >= LEAST and not is_known(s) and ratio(s) < (below if any(c.isdigit() for c in s) else min(below, LETTERS))


def random_parts(s: str, ratio: Ratio, below: float) -> list[tuple[int, int]]:
    """Random spans within a run: stretches of parts none of which is a readable word, else the single parts of a stretch."""
    stretches: list[list[tuple[int, int]]] = [[]]
    for m in PART.finditer(s):
        p = m.group()
        if WORD.fullmatch(p) and (len(p) < 4 or ratio(p) >= 2):
            stretches.append([])
        else:
            stretches[-1].append(m.span())
    out = []
    for parts in filter(None, stretches):
        whole = (parts[0][0], parts[-1][1])
        if is_random(s[whole[0] : whole[1]], ratio, below):
            out.append(whole)
        elif not is_known(s[whole[0] : whole[1]]):
            out += [(a, b) for a, b in parts if is_random(s[a:b], ratio, below)]
    return out


def random_spans(text: str, ratio: Ratio, below: float, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m.group()
        spans = [(0, len(s))] if is_random(s, ratio, below) else [] if UUID.fullmatch(s) else random_parts(s, ratio, below)
        for x, y in spans:
            if not any(a <= m.start() + x and m.start() + y <= b for a, b, _ in taken):
                out.append((m.start() + x, m.start() + y, "random"))
    return out


def find_secrets(text: str, ratio: Ratio, below: float) -> list[tuple[int, int, str]]:
    found = base_spans(text)
    found += random_spans(text, ratio, below, found)
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_scan(
    docs: DataFrame, ranks_file: str, pattern: str, below: float = 2.0, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, spans) of every row; ``spans`` is sorted by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Ratio(ranks_file, pattern)  # made by each task, so that a reused worker holds nothing back
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in bt.slices(batches, 1):
            spans = [
                [{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(x.as_py() or "", ratio, below)] for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["id", "spans"])

    kind = docs.select(F.col(id_column)).schema[0].dataType.simpleString()
    return docs.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text")
    ).mapInArrow(run, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_column)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secret_scan(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """Contract digest; ``spans`` of a text without any is the empty string."""
    found = secret_scan(docs, ranks_file, pattern)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, ranks_file: str, pattern: str, mark: str = "[SECRET]", text_column: str = "text") -> DataFrame:
    """The documents with every span replaced by ``mark``; other columns stay, ``n_chars`` follows the text. A null text stays null."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = Ratio(ranks_file, pattern)  # made by each task, so that a reused worker holds nothing back
        for batch in bt.slices(batches, at):
            texts = [None if (x := v.as_py()) is None else cut(x, find_secrets(x, ratio, 2.0), mark) for v in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(
        "n_chars",
        F.when(F.col(text_column).isNull(), F.col("n_chars")).otherwise(F.char_length(text_column).cast(docs.schema["n_chars"].dataType)),
    ) if "n_chars" in docs.columns else out


def cut(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]]) if parts else text
