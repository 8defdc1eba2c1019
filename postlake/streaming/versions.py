"""A table of versions over plain Parquet: a commit log beside the data, written last.

Rows are dealt over buckets by a key. A version is a manifest that names, for every bucket, the folder that holds its rows; it
lists the batches that led to it. A commit writes the touched buckets into a folder of its own, then puts the manifest in place by one
rename, which fails where another writer has put that version before. Readers follow the last manifest, so they see a
version whole or not at all, and a driver lost at any point leaves the former version as it was. Nothing is overwritten.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class CommitLog:
    """Numbered manifests under path/log, each put in place by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def names(self, folder: str) -> list[str]:
        """What lies in a folder below path; nothing where there is none."""
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("log") if re.fullmatch(r"[0-9]+\.json", n))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the last; None where there is none yet."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        return json.loads(self.spark.read.text(self._log(version), wholetext=True).first()[0])

    def publish(self, manifest: dict) -> None:
        aside = self._path(f"{self.path}/log/_{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(self._log(manifest["version"]))
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is taken")


class VersionedTable(CommitLog):
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        """buckets bounds what a manifest names and what a commit collects; at scale take some thousands."""
        super().__init__(spark, path)
        self.key, self.buckets = key, buckets

    def manifest(self, version: int | None = None) -> dict:
        return super().manifest(version) or {"version": -1, "buckets": {}, "batches": {}, "schema": None}

    # -- reading

    def bucket(self, column=None):
        return F.pmod(F.xxhash64(F.col(self.key) if column is None else column), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version, of some buckets only where they are named; None of an empty table."""
        found = self.manifest(version)
        if found["schema"] is None:
            return None
        schema = StructType.fromJson(found["schema"])
        folders = [f for b, f in found["buckets"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    # -- writing

    def commit(self, rows: DataFrame, touched: list[int] | None, writer: str = "", batch: int | None = None, since: dict | None = None, before_publish=None) -> int:
        """Make rows the content of the touched buckets (of all, where None) and return the version.

        since is the manifest that rows were derived from; a version that came after it makes a :class:`Conflict`.
        """
        since = since or self.manifest()
        folder = f"data/{since['version'] + 1:012d}-{uuid.uuid4().hex}"
        # a bucket to a few files: rows of a bucket go to one task, unless it is large enough for the engine to split it
        rows.withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        there = {int(n.removeprefix("_bucket=")) for n in self.names(folder) if n.startswith("_bucket=")}
        kept = {b: f for b, f in since["buckets"].items() if touched is not None and int(b) not in touched}
        batches = dict(since["batches"])
        if batch is not None:
            batches[writer] = batch
        manifest = {"version": since["version"] + 1, "buckets": kept | {str(b): f"{folder}/_bucket={b}" for b in sorted(there)}, "batches": batches, "schema": rows.schema.jsonValue()}
        if before_publish:
            before_publish()
        self.publish(manifest)
        return manifest["version"]

    def update(self, batch_rows: DataFrame, change, writer: str, batch: int, before_publish=None) -> int:
        """Commit change(rows of the buckets that batch_rows touches, batch_rows), once a batch of a writer: one that comes again changes nothing."""
        since = self.manifest()
        if since["batches"].get(writer, -1) >= batch:
            return since["version"]
        touched = [r[0] for r in batch_rows.select(self.bucket()).distinct().collect()]  # at most as many as there are buckets
        if not touched:
            return since["version"]
        now = self.read(since["version"], touched)
        return self.commit(change(now, batch_rows).select(*now.columns), touched, writer, batch, since, before_publish)

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the last versions, and folders that no version left names (also those of commits that never came to be)."""
        known = self.versions()
        for version in known[:-keep]:
            self.delete(f"log/{version:012d}.json")
        named = {f.split("/")[1] for v in known[-keep:] for f in self.manifest(v)["buckets"].values()}
        for name in self.names("data"):
            if name not in named:
                self.delete(f"data/{name}")
