"""Tables that change by commits: Parquet by month, a manifest for each version, readers on a stated version.

A write makes new files for the months that it touches and then puts the manifest of the next version in place by one
rename that fails if that version is there already; the writer then begins again from the newer one, so that no rows of
another writer are lost. Files are never changed: untouched months keep theirs, and every version can be read until
``forget``. A batch with a name is applied once, however often it is replayed.

Keys hold the time column, so that a key's month is known. NULL times go to a month of their own. A manifest lists the
folders of the months and the names of the last ``KEPT`` batches; the rows are read and written by Spark alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.store import absent, one_per_key, replaced, upserted

#: Names of batches that a manifest keeps.
KEPT = 10_000
NO_TIME = "none"


class Conflict(RuntimeError):
    """Other writers were first too often."""


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, ts: str = "ts") -> None:
        self.spark, self.path, self.ts = spark, path.rstrip("/"), ts
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    # -- versions

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._file("").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder, fs = self._file("_commits"), self._fs()
        if not fs.exists(folder):
            return []
        return sorted(int(name[:-5]) for name in (s.getPath().getName() for s in fs.listStatus(folder)) if name.endswith(".json") and name[0] != ".")

    def _manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "months": {}, "batches": [], "schema": None}
        version = found[-1] if version is None else version
        if version not in found:
            raise ValueError(f"no version {version}")
        stream = self._fs().open(self._file(f"_commits/{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether this manifest became its version; False if there is one."""
        fs, hidden = self._fs(), self._file(f"_commits/.{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(hidden), fs.makeQualified(self._file(f"_commits/{manifest['version']:010d}.json")), options)
            return True
        except Py4JJavaError as error:
            fs.delete(hidden, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise

    # -- reading

    def read(self, version: int | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """The rows of a version (the newest if none is named), of times from ``start`` up to ``end``: only the months between are opened."""
        return self._rows(self._manifest(version), start, end)

    def _rows(self, manifest: dict, start: str | None = None, end: str | None = None, months: set[str] | None = None) -> DataFrame:
        if manifest["schema"] is None:
            raise ValueError("the table has no version")
        schema = StructType.fromJson(manifest["schema"])
        inside = lambda m: (months is None or m in months) and (m == NO_TIME and not start and not end or m != NO_TIME and (not start or m >= start[:7]) and (not end or m <= end[:7]))
        folders = [f"{self.path}/{folder}" for m, folder in sorted(manifest["months"].items()) if inside(m)]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        for limit, kept in ((start, lambda c, x: c >= x), (end, lambda c, x: c < x)):
            rows = rows.where(kept(F.col(self.ts), F.lit(limit).cast(schema[self.ts].dataType))) if limit else rows
        return rows

    # -- writing

    def _month(self) -> Column:
        return F.coalesce(F.date_format(self.ts, "yyyy-MM"), F.lit(NO_TIME))

    def _commit(self, batch: str | None, change: Callable[[dict], tuple[set[str], DataFrame] | None], tries: int) -> int:
        """Applies ``change``, which gives the months that it touches and their rows, to the newest version until no one is first."""
        for _ in range(tries):
            now = self._manifest()
            if batch is not None and batch in now["batches"]:
                return now["version"]
            changed = change(now)
            if changed is None:
                return now["version"]
            months, rows = changed
            folder = f"data/{uuid.uuid4().hex}"
            rows.withColumn("_month", self._month()).write.partitionBy("_month").parquet(f"{self.path}/{folder}")
            there = {s.getPath().getName().removeprefix("_month=") for s in self._fs().listStatus(self._file(folder)) if s.isDirectory() and s.getPath().getName().startswith("_month=")}
            kept = {m: f for m, f in now["months"].items() if m not in months}
            manifest = {
                "version": now["version"] + 1, "batch": batch, "months": kept | {m: f"{folder}/_month={m}" for m in there},
                "batches": (now["batches"] + ([batch] if batch is not None else []))[-KEPT:], "schema": rows.schema.jsonValue(),
            }
            if self._publish(manifest):
                return manifest["version"]
            self._fs().delete(self._file(folder), True)
        raise Conflict(f"{tries} tries met a newer version of {self.path}")

    def _touched(self, new: DataFrame) -> set[str]:
        return {r[0] for r in new.select(self._month()).distinct().collect()}  # months

    def _old(self, now: dict, months: set[str], like: DataFrame) -> DataFrame:
        return like.limit(0) if now["schema"] is None else self._rows(now, months=months)

    def _keyed(self, new: DataFrame, keys: list[str], batch: str | None, tries: int, merge: Callable[[DataFrame], DataFrame]) -> int:
        if self.ts not in keys:
            raise ValueError(f"keys hold {self.ts}")

        def change(now: dict) -> tuple[set[str], DataFrame] | None:
            months = self._touched(new)
            return (months, merge(self._old(now, months, new))) if months else None

        return self._commit(batch, change, tries)

    def upsert(self, new: DataFrame, keys: list[str], newest: str | None = None, batch: str | None = None, tries: int = 10) -> int:
        """The version after the rows of ``new`` have taken the place of those with their keys."""
        return self._keyed(new, keys, batch, tries, lambda old: upserted(old, new, keys, newest))

    def append_absent(self, new: DataFrame, keys: list[str], newest: str | None = None, batch: str | None = None, tries: int = 10) -> int:
        """The version after the rows of ``new`` whose keys were not there have been added."""
        return self._keyed(new, keys, batch, tries, lambda old: old.unionByName(absent(new, old, keys, newest), allowMissingColumns=True))

    def replace_between(self, new: DataFrame, start: str, end: str, batch: str | None = None, tries: int = 10) -> int:
        """The version after the rows from ``start`` up to ``end`` have been deleted and those of ``new`` inserted."""

        def change(now: dict) -> tuple[set[str], DataFrame]:
            months = self._touched(new) | {m for m in now["months"] if m != NO_TIME and start[:7] <= m <= end[:7]}
            kind = new.schema[self.ts].dataType
            between = (F.col(self.ts) >= F.lit(start).cast(kind)) & (F.col(self.ts) < F.lit(end).cast(kind))
            return months, replaced(self._old(now, months, new), new, between)

        return self._commit(batch, change, tries)

    def create(self, rows: DataFrame, keys: list[str] | None = None, newest: str | None = None) -> int:
        """The first version; an error where there is one, as nothing is ever overwritten."""
        if self.versions():
            raise FileExistsError(self.path)
        version = self._commit(None, lambda now: None if now["version"] else (set(), one_per_key(rows, keys, newest) if keys else rows), 1)
        return version

    def forget(self, before: int) -> None:
        """Deletes the versions before one, and the files that no other has. Not while others write."""
        kept = [self._manifest(v) for v in self.versions() if v >= before]
        used = {f.split("/")[1] for m in kept for f in m["months"].values()}
        fs = self._fs()
        for version in [v for v in self.versions() if v < before]:
            fs.delete(self._file(f"_commits/{version:010d}.json"), False)
        for status in fs.listStatus(self._file("data")) if kept else []:
            if status.getPath().getName() not in used:
                fs.delete(status.getPath(), True)
