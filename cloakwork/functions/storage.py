"""Cut points in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary one; a cluster must name it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cloakwork-"))
    return spark.sparkContext.getCheckpointDir()


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cloakwork-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage without tying the rows to any executor: a later read
    needs only the shared files. The files stay until the folder is emptied,
    because the returned DataFrame is lazy; what an operator needs only until
    it has its result goes through a ``Scratch``.
    """
    return _written(df)[1]
