"""Intermediate tables of an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import _written, materialize, shared_dir

__all__ = ["MAX_BROADCAST", "Scratch", "materialize", "shared_dir", "sized"]


class Scratch:
    """Intermediate tables of one operator, removed together."""

    def __init__(self):
        self.written: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path, out = _written(df)
        self.written.append((df.sparkSession, path))
        return out

    def clear(self) -> None:
        for spark, path in self.written:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.written.clear()


#: Bytes of a written table up to which it is sent to all executors.
MAX_BROADCAST = 32 << 20


def sized(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A written table, marked for broadcasting if its rows of ``row_bytes`` are within ``MAX_BROADCAST``; else it is shuffled like any other."""
    return F.broadcast(df) if df.count() * row_bytes <= MAX_BROADCAST else df
