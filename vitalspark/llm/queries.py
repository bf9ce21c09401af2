"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, collocations, decontaminate, minhash_dedup, vector_codes


def vocabulary(name: str) -> str:
    """Place of a vocabulary file: in ``VITALSPARK_TOKENIZERS``, or where the public tokenizers package has it."""
    if folder := os.environ.get("VITALSPARK_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import op1_minhash_dedup

    return op1_minhash_dedup(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import op2_token_counts

    return op2_token_counts(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import op3_fingerprints

    return op3_fingerprints(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import op4_sentencepiece

    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        return op4_sentencepiece(read(spark, sf_dir, "documents"), f.read())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import op5_language_id

    return op5_language_id(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import op6_suffix_dedup

    return op6_suffix_dedup(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import op7_secret_scan

    return op7_secret_scan(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), split_pattern())


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import op8_sharding

    return op8_sharding(read(spark, sf_dir, "documents"))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import op9_preference_format

    return op9_preference_format(read(spark, sf_dir, "conversations"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import op10_decontaminate

    return op10_decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import op11_vector_codes

    return op11_vector_codes(read(spark, sf_dir, "embeddings"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import op12_url_filter

    return op12_url_filter(read(spark, sf_dir, "pages"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import op13_collocations

    return op13_collocations(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_fingerprints": op3_fingerprints,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_preference_format": op9_preference_format,
    "op10_decontaminate": op10_decontaminate,
    "op11_vector_codes": op11_vector_codes,
    "op12_url_filter": op12_url_filter,
    "op13_collocations": op13_collocations,
}

#: DuckDB SQL over the same tables, where SQL can express the operator.
ORACLE_SQL: dict[str, str] = {
    "op9_preference_format": chat_format.ORACLE_SQL,
    "op1_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
