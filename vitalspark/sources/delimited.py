"""Delimited inputs: a CSV with sections (SRC12) and pipe-separated object metadata (SRC13)."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def column_name(name: str) -> str:
    """Lower case, words joined by ``_``."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z]+", "_", name.strip().lower().replace("%", "pct "))).strip("_")


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of each header line: the first line with a cell ``section`` in a file. The driver holds file names, as Spark's own file listing does."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("no"))
    heads = lines.where(F.col("value").rlike(r'(?i)(^|,)\s*"?\s*section\s*"?\s*(,|$)')).groupBy("path").agg(F.min_by("value", "no").alias("head"))
    found: dict[str, list[str]] = {}
    for r in heads.orderBy("path").collect():
        found.setdefault(r["head"], []).append(r["path"])
    return found


def _cells(spark: SparkSession, path: str, aliases: dict[str, str]) -> list[DataFrame]:
    """A frame for each header that files have, its columns by normalised name; a repeated name is its last column. ``__bad`` has lines with more or
    fewer cells than names, ``__path`` the file."""
    out = []
    for head, files in _headers(spark, path).items():
        names = next(csv.reader([head]))
        plain = [aliases.get(column_name(c), column_name(c)) for c in names]
        schema = StructType([*[StructField(f"c{i}", StringType()) for i in range(len(names))], StructField("__bad", StringType())])
        raw = spark.read.csv(files, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad")
        last = {name: i for i, name in enumerate(plain) if name}
        out.append(raw.select(*[F.col(f"c{i}").alias(name) for name, i in last.items()], "__bad", F.col("_metadata.file_path").alias("__path")))
    return out


def sectioned_csv(
    spark: SparkSession, path: str, tables: dict[str, list[str]], aliases: dict[str, str] | None = None
) -> dict[str, DataFrame]:
    """SRC12: a frame for each mapped section with its columns; names are normalised, then looked up in ``aliases``. Other sections are left out.

    Every file is read by its own header, so files may have other columns or another order. Lines with more or fewer cells than their header are
    left out (``csv_rejects`` has them); files without a column ``section`` give nothing."""
    parts = _cells(spark, path, aliases or {})
    out = {}
    for s, columns in tables.items():
        rows = [
            p.where(F.col("__bad").isNull() & (F.lower(F.trim("section")) == s.lower())).select(
                *[F.col(c) if c in p.columns else F.lit(None).cast("string").alias(c) for c in columns]
            ) for p in parts
        ]
        out[s] = reduce(DataFrame.unionByName, rows) if rows else spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    return out


def csv_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of SRC12's lines that have more or fewer cells than their file's header."""
    # Spark reads the text of a bad line only together with some cell of it
    read = lambda p: F.length(F.concat_ws("", *[F.col(f"`{c}`") for c in p.columns[:-2]])) >= 0
    parts = [p.where(F.col("__bad").isNotNull() & read(p)).select(F.col("__path").alias("path"), F.col("__bad").alias("line")) for p in _cells(spark, path, {})]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "path string, line string")


def metadata_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """SRC13: every column trimmed, the empty string NULL; ``index_columns`` is parsed from its JSON if present."""
    want = StructType.fromDDL(schema)
    raw = spark.read.csv(path, sep="|", header=header, schema=", ".join(f"`{f.name}` string" for f in want), quote="\u0000")
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))

    def typed(f) -> Column:
        if f.name == "index_columns":
            return F.from_json(clean(f.name), "array<struct<col:string,pos:int,desc:string>>").alias(f.name)
        return clean(f.name).try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in want])
