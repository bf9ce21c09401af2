"""Keyed sinks on partitioned Parquet tables (SNK1-SNK4). Each call is idempotent: the same input again changes nothing.

Only the partitions that the input touches are read and rewritten (``partitionOverwriteMode=dynamic``), so a load costs what it brings,
not what is there. The new partitions are first written beside the table in the shared folder, since a job must not read what it overwrites.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.select import newest_by
from .storage import delete, exists, shared_dir


class KeyedTable:
    """A Parquet table partitioned by ``partitions`` (columns, part of every key)."""

    def __init__(self, spark: SparkSession, path: str, partitions: Sequence[str]):
        self.spark, self.path, self.partitions = spark, path, list(partitions)

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def _folder(self, row) -> str:
        name = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return "/".join([self.path, *[name(c, None if row[c] is None else str(row[c])) for c in self.partitions]])

    def _touched(self, df: DataFrame) -> DataFrame:
        """The table's rows in the partitions of ``df``; the join prunes partitions at run time."""
        keys = df.select(*self.partitions).distinct()
        return self.read().join(F.broadcast(keys) if len(keys.take(10_001)) <= 10_000 else keys, self.partitions, "left_semi")

    def _spread(self, df: DataFrame) -> DataFrame:
        """Dealt by partition for few files; Spark splits large partitions to several tasks."""
        return df.hint("rebalance", *self.partitions)

    def _overwrite(self, df: DataFrame) -> None:
        stage = f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex[:12]}"
        df.write.parquet(stage)
        self._replace(self.spark.read.schema(df.schema).parquet(stage))

    def _replace(self, staged: DataFrame) -> None:
        self._spread(staged).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(*self.partitions).parquet(self.path)

    def insert_if_absent(self, df: DataFrame, keys: Sequence[str]) -> None:
        """SNK1: rows whose key is new are appended, of equal ones in the input any one."""
        new = df.dropDuplicates(list(keys))
        if self.exists():
            new = new.join(self._touched(df).select(*keys), list(keys), "left_anti")
        self._spread(new).write.mode("append").partitionBy(*self.partitions).parquet(self.path)

    def upsert(self, df: DataFrame, keys: Sequence[str], refresh: Sequence[str] | None = None, order: str | None = None) -> None:
        """SNK2: new keys are added; of known keys the columns in ``refresh`` (all others by default) take the new value where it is not NULL.

        ``order`` names the column whose largest value wins among input rows of one key."""
        keys = list(keys)
        new = newest_by(df, keys, F.col(order).desc_nulls_last()) if order else df.dropDuplicates(keys)
        if not self.exists():
            self._overwrite(new)
            return
        columns = [c for c in df.columns if c not in keys]
        fresh = set(columns if refresh is None else refresh)
        old = self._touched(df)
        old = old.select(*keys, *[F.col(c) if c in old.columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns])
        both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*keys, *columns).withColumn("__new", F.lit(1)))
        side = lambda c, n: F.max(F.when(F.col("__new") == n, F.struct(F.col(c).alias("v"))))["v"]
        merged = [
            F.coalesce(side(c, 1), side(c, 0)).alias(c) if c in fresh else F.when(
                F.max("__new") == F.min("__new"), F.coalesce(side(c, 0), side(c, 1))
            ).otherwise(side(c, 0)).alias(c)
            for c in columns
        ]
        self._overwrite(both.groupBy(*keys).agg(*merged).select(*df.columns))

    def refresh(self, touched: DataFrame, recompute) -> None:
        """SNK3: ``recompute(keys)`` gives the rollup rows of the touched partitions; only those are rewritten, and those of which no row
        comes out are emptied."""
        keys = touched.select(*self.partitions).distinct()
        new = recompute(keys)
        if not self.exists():
            self._overwrite(new)
            return
        stage = f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex[:12]}"
        new.write.parquet(stage)
        staged = self.spark.read.schema(new.schema).parquet(stage)
        there = self.read().select(*self.partitions).distinct().join(keys, self.partitions, "left_semi")
        gone = there.join(staged.select(*self.partitions).distinct(), self.partitions, "left_anti").collect()  # partitions, not rows
        self._replace(staged)
        for row in gone:
            delete(self.spark, self._folder(row))

    def delete(self, keys: DataFrame, on: Sequence[str]) -> None:
        """SNK4: rows with a key in ``keys`` go; partitions without any stay as they are.

        Partitions of which nothing is left are deleted first, then the others rewritten from a finished copy, each at once. If the driver is lost
        between, the same call again deletes what is left to delete."""
        old = self.read()
        hit = old.join(keys.select(*on).distinct(), list(on), "left_semi").select(*self.partitions).distinct()
        rest = old.join(hit, self.partitions, "left_semi").join(keys.select(*on).distinct(), list(on), "left_anti")
        gone = hit.join(rest.select(*self.partitions).distinct(), self.partitions, "left_anti").collect()  # whole partitions of the deleted keys
        stage = f"{shared_dir(self.spark)}/stage-{uuid.uuid4().hex[:12]}"
        rest.write.parquet(stage)
        staged = self.spark.read.schema(rest.schema).parquet(stage)
        for row in gone:
            delete(self.spark, self._folder(row))
        self._replace(staged)
