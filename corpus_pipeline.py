"""A training-corpus pipeline over ``documents``: five stages, each applying one operator to all its predecessor kept.

language    documents without an identified language go
near_dups   of each group of near-duplicates the smallest doc_id stays
            a document without an id has nothing to be told by and always stays, here and in the other stages
benchmarks  passages of ``benchmark`` are cut out of the texts; a document of which no word is left goes
secrets     secrets in the texts are replaced by a mark
pieces      the texts become SentencePiece numbers; this last stage returns them instead of the texts
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspark.llm import decontaminate, language_id, minhash_dedup, secret_scan, sentencepiece_codec
from vitalspark.llm.queries import read, split_pattern, vocabulary
from vitalspark.llm.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(language_id.training_rows(docs)))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash_dedup.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_hits(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        codec = sentencepiece_codec.Codec(sentencepiece_codec.load(f.read()))
    out = sentencepiece_codec.encode_decode(docs, codec)
    return out.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        "piece_ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "round_trip",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language), ("near_dups", near_dups), ("benchmarks", benchmarks), ("secrets", secrets), ("pieces", pieces)
]

#: No SQL: language models, MinHash components and piece segmentations are beyond it. tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        before, docs = docs, out if k + 1 == len(STAGES) else scratch.table(out)
        if 0 < k < len(STAGES) - 1:
            scratch.drop(before)
    return docs
