"""Tables that cut lineage, kept in the folder which driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir

#: Spark's own setting to delete a query's shuffle files when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_end_with_the_query(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Writes intermediate tables under one fresh folder of the shared directory.

    A written table survives the loss of executors and is computed once, however often it is read; its query's shuffle files go at its end.
    ``drop`` deletes tables that no later step reads, ``drop_all`` all but those that are still to be read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._n = 0

    def table(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read again. ``by``: a column of few values by which the files are laid out."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        with shuffles_end_with_the_query(self.spark):
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def tables(self) -> list[DataFrame]:
        """The tables that have not been dropped."""
        return [t for t, _ in self._paths.values()]

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            _, path = self._paths.pop(id(t))
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def drop_all(self, *but: DataFrame) -> None:
        kept = {id(t) for t in but}
        self.drop(*[t for k, (t, _) in list(self._paths.items()) if k not in kept])
