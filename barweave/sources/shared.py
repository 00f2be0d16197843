"""Tables in the folder that the driver and all executors see, which cut the lineage of what is read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder for a local master (tests) and an error for a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barweave-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        _forget_on_exit(spark, root)
    return root.rstrip("/")


def _forget_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table of the shared folder that is deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/barweave/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _forget_on_exit(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
