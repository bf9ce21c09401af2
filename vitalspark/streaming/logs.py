"""What micro-batches leave behind, each batch once: rows (``BatchLog``) and finished steps (``StepLedger``).

Spark repeats a micro-batch with the same number and the same input until it is committed, and never two at a time. So a folder named by the
number, written whole, holds a batch once however often it is tried. Both kinds of log belong to one checkpoint and lie in its folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import delete, exists, folders, touch


class BatchLog:
    """Rows by batch. ``merge`` brings the rows of many batches to one row a key and may be applied to its own results.

    Every ``every`` batches, what is committed is merged into one folder, so the number of folders stays bounded. A merged folder counts once it
    is complete; what it replaces is deleted one merge later, when no reader of the old listing can be left."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, merge: Callable[[DataFrame], DataFrame], every: int = 64):
        self.spark, self.path, self.schema, self.merge, self.every = spark, path, schema, merge, every

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(f.split("=")[1]) for f in folders(self.spark, self.path) if f.startswith(f"{kind}="))

    def _complete(self) -> list[int]:
        return [n for n in self._numbers("upto") if exists(self.spark, f"{self.path}/upto={n}/_SUCCESS")]

    def append(self, batch: int, rows: DataFrame) -> None:
        """The rows of a batch, in place of those of an earlier try of it. ``batch`` is the only one that is not committed."""
        if batch and batch % self.every == 0:
            self._compact(batch - 1)
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def read(self, upto: int | None = None) -> DataFrame:
        """The merged rows of all batches, or of those up to a number."""
        known = lambda n: upto is None or n <= upto
        whole = [n for n in self._complete() if known(n)][-1:]
        paths = [f"{self.path}/upto={n}" for n in whole]
        paths += [f"{self.path}/batch={n}" for n in self._numbers("batch") if known(n) and n > max(whole, default=-1)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*paths)).select(*self.schema.names)

    def _compact(self, upto: int) -> None:
        if upto in self._complete():  # by an earlier try of the same batch
            return
        earlier = self._complete()
        self.read(upto).write.mode("overwrite").parquet(f"{self.path}/upto={upto}")
        old = max(earlier, default=-1)  # merged a whole turn ago
        for n in [n for n in self._numbers("batch") if n <= old]:
            delete(self.spark, f"{self.path}/batch={n}")
        for n in [n for n in self._numbers("upto") if n < old]:
            delete(self.spark, f"{self.path}/upto={n}")


class StepLedger:
    """Finished steps of each batch, and the keys that its first step touched."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, batch: int, step: str) -> str:
        return f"{self.path}/batch={batch}/{step}"

    def done(self, batch: int, step: str) -> bool:
        return exists(self.spark, f"{self._at(batch, step)}/_SUCCESS")

    def mark(self, batch: int, step: str) -> None:
        touch(self.spark, f"{self._at(batch, step)}/_SUCCESS")

    def record(self, batch: int, step: str, keys: DataFrame) -> None:
        """Marks a step as finished together with the keys that it touched."""
        keys.write.mode("overwrite").parquet(self._at(batch, step))

    def keys(self, batch: int, step: str) -> DataFrame:
        return self.spark.read.parquet(self._at(batch, step))
