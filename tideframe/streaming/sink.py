"""An upsert table for streams: immutable part files by (key hash, day), and a manifest written last.

A micro-batch reads and rewrites only the parts that its rows fall into. Its files go to a folder of its
own; the manifest of the batch, which names the folder of every part, appears by one rename when they are
complete, and is the only thing that readers look at. So a batch that is lost half-way changes nothing, a
batch that runs again finds its manifest and is done, and a reader keeps the files of the version that it
began with: those of the last ``VERSIONS`` manifests stay.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSIONS = 3
#: Hash groups of keys; with days of ``bucket`` (if there is one) they make the parts.
GROUPS = 16
DAY = 86_400


class MergeTable:
    """A table of one row for each of ``keys`` below ``path``; ``keep_last`` keeps the newest buckets of each series."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], keep_last: int | None = None, groups: int = GROUPS):
        self.spark, self.path, self.keys, self.keep_last, self.groups = spark, path.rstrip("/"), keys, keep_last, groups
        self.series = [k for k in keys if k != "bucket"]
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        """{"schema": ..., "parts": {"group/day": folder}}"""
        stream = self.fs.open(self._path(f"manifests/{version}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _commit(self, version: int, manifest: dict) -> None:
        pending = self._path(f"manifests/.{version}-{uuid.uuid4().hex}")
        out = self.fs.create(pending)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self.fs.rename(pending, self._path(f"manifests/{version}.json")):
            self.fs.delete(pending, False)  # another attempt of the batch was first

    def _part(self) -> list[Column]:
        day = F.expr(f"bucket div {DAY}") if "bucket" in self.keys else F.lit(0)
        return [F.pmod(F.xxhash64(*self.series) if self.series else F.lit(0), F.lit(self.groups)).cast("int").alias("_group"), day.cast("long").alias("_day")]

    def _read(self, manifest: dict, parts: list[str]) -> DataFrame | None:
        schema = self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(manifest["schema"])).toDDL()
        paths = [f"{self.path}/data/{manifest['parts'][p]}/_group={p.split('/')[0]}/_day={p.split('/')[1]}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of one that is still kept."""
        manifest = self.manifest(self.versions()[-1] if version is None else version)
        found = self._read(manifest, sorted(manifest["parts"]))
        return found if found is not None else self.spark.createDataFrame([], self.spark._jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(manifest["schema"])).toDDL())

    def merge(self, batch: DataFrame, version: int) -> list[str]:
        """Rows of ``batch`` replace those of their keys; returns the parts that were rewritten."""
        versions = self.versions()
        if version in versions:
            return []
        before = self.manifest(max(v for v in versions if v < version)) if any(v < version for v in versions) else {"parts": {}}
        known = before["parts"]
        batch = batch.persist()
        try:
            touched = {f"{r['_group']}/{r['_day']}" for r in batch.select(*self._part()).distinct().collect()}
            if self.keep_last:  # a series' newest buckets may push out its oldest: whole groups, which are bounded, are gone through
                groups = {p.split("/")[0] for p in touched}
                touched |= {p for p in known if p.split("/")[0] in groups}
            old = self._read(before, sorted(touched & known.keys())) if touched & known.keys() else None
            out = batch
            if old is not None:
                out = old.join(batch.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(batch)
            if self.keep_last:
                rank = F.dense_rank().over(Window.partitionBy(*self.series).orderBy(F.desc("bucket")))
                out = out.withColumn("_k", rank).where(F.col("_k") <= self.keep_last).drop("_k")
            folder = f"b{version}-{uuid.uuid4().hex}"
            where = f"{self.path}/data/{folder}"
            out.select("*", *self._part()).repartition("_group", "_day").write.partitionBy("_group", "_day").parquet(where)
        finally:
            batch.unpersist()
        written = set()
        for group in self._names(f"data/{folder}"):
            if group.startswith("_group="):
                written |= {f"{group[7:]}/{day[5:]}" for day in self._names(f"data/{folder}/{group}") if day.startswith("_day=")}
        parts = {p: f for p, f in known.items() if p not in touched} | dict.fromkeys(written, folder)
        self._commit(version, {"schema": json.loads(batch.schema.json()), "parts": parts})
        self._clean(version)
        return sorted(written)

    def _clean(self, version: int) -> None:
        """Deletes old manifests, and folders that no manifest kept names and no batch under way can own."""
        versions = self.versions()
        for v in versions[:-VERSIONS]:
            self.fs.delete(self._path(f"manifests/{v}.json"), False)
        used = {f for v in versions[-VERSIONS:] for f in self.manifest(v)["parts"].values()}
        for name in self._names("data"):
            if name not in used and int(name[1:].split("-")[0]) <= version:
                self.fs.delete(self._path(f"data/{name}"), True)


def upsert(path: str, keys: list[str], keep_last: int | None = None, groups: int = GROUPS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink into a ``MergeTable``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        MergeTable(batch.sparkSession, path, keys, keep_last, groups).merge(batch, batch_id)

    return write
