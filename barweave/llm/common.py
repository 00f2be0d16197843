"""What several operators of this subpackage share: the shared folder, written tables and text columns."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six white-space characters that end a word, as a Java regular-expression class body.
WHITE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent and the master is local (tests), a temporary folder is made and set. On a cluster
    an absent setting is an error, as a machine-local folder would lose data.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barweave-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        _forget_on_exit(spark, root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path for one table or set of files in the shared folder; it is deleted when the application ends, or by the ``Scratch`` around the call."""
    path = f"{shared_folder(spark)}/barweave/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _forget_on_exit(spark, path)
    if (scratch := _scratch.get()) is not None:
        scratch.paths.append(path)
    return path


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """The folders made within ``with Scratch(spark) as used:`` by this thread; ``used.drop()`` deletes them.

    Results are lazy: write what is built on these folders before dropping them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self._token = _scratch.set(self)
        return self

    def __exit__(self, *error: object) -> None:
        _scratch.reset(self._token)

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget_on_exit(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    return written_to(df, new_folder(df.sparkSession, tag), compression)


def written_to(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column) -> Column:
    """The words (runs without the six white-space characters) of a text, in order; none for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
