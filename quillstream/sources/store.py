"""Tables on shared storage that change together: hash buckets of Parquet files, and a log of commits that names them.

A table's rows lie in buckets by the hash of their key. A change reads and writes the buckets of its own keys only; the files of all
others are named again, untouched. What a transaction writes is invisible until its manifest, which names the files of every table, is put into
the log under the next number, if that is not taken: readers see all of a transaction's tables or none, of two writers from one
version one wins, and files of writers that died are garbage that vacuum() removes.

Manifests are put by a rename that fails where the name exists (HDFS), by a hard link on local disks. Object stores without such a
rename need one that has it for the log. Files are immutable, so readers of an older version are never disturbed while it is kept.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.operators.lineage import cut
from quillstream.operators.merge import latest

BUCKETS = 16


class Conflict(Exception):
    """Another writer has committed the version that this one wanted to."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Snapshot:
    """The tables as one commit left them. tables: name to keys, buckets, schema (JSON) and files by bucket; meta: what the writer noted."""

    spark: SparkSession
    version: int
    tables: dict
    meta: dict

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def files(self, name: str, buckets: list[int] | None = None) -> list[str]:
        own = self.tables[name]["files"]
        return [f for b, fs in sorted(own.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets for f in fs]

    def __getitem__(self, name: str) -> DataFrame:
        return self.read(name)

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        schema, files = T.StructType.fromJson(json.loads(self.tables[name]["schema"])), self.files(name, buckets)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def of_keys(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows with one of the keys (a frame of the table's key columns): only their buckets are read."""
        own = self.tables[name]
        asked = cut(keys.select(*own["keys"]).distinct())
        touched = [r[0] for r in asked.select(bucket_of(own["keys"], own["buckets"])).distinct().collect()]
        return self.read(name, touched).join(asked, own["keys"], "left_semi")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm  # noqa: SLF001
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())  # noqa: SLF001

    def _listed(self, folder: str) -> list:
        at = self._path(folder)
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._listed(f"{self.root}/_commits")]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        at = self._path(f"{self.root}/_commits/{version:012d}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self, version: int | None = None) -> Snapshot:
        """The last committed version (0 where there is none), or an earlier one."""
        known = self._versions()
        version = (known[-1] if known else 0) if version is None else version
        told = self._manifest(version) if version else {"tables": {}, "meta": {}}
        return Snapshot(self.spark, version, told["tables"], told["meta"])

    def begin(self) -> Transaction:
        return Transaction(self, self.current())

    def run(self, change: Callable[[Transaction], None], attempts: int = 5) -> Snapshot:
        """Applies a change to the last version and commits it, from anew where another writer was faster."""
        for left in reversed(range(attempts)):
            t = self.begin()
            change(t)
            try:
                return t.commit()
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def put(self, version: int, manifest: dict) -> bool:
        """Whether the manifest now is that version: not if there was one."""
        folder = f"{self.root}/_commits"
        self._fs.mkdirs(self._path(folder))
        spare, last = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version:012d}.json")
        out = self._fs.create(spare, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                try:
                    os.link(spare.toUri().getPath(), last.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(last) and self._fs.rename(spare, last)
        finally:
            self._fs.delete(spare, False)

    def vacuum(self, keep: int = 2, older_than: float = 3600.0) -> int:
        """Deletes the manifests but the last ``keep``, and files that none of these names and that are older than so many seconds
        (a writer may still be about to name them). Returns how many files went."""
        known = self._versions()
        named = {f for v in known[-keep:] for t in self._manifest(v)["tables"].values() for fs in t["files"].values() for f in fs}
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/_commits/{v:012d}.json"), False)
        gone, oldest = 0, 1000 * (time.time() - older_than)
        files = self._fs.listFiles(self._path(f"{self.root}/data"), True) if self._fs.exists(self._path(f"{self.root}/data")) else None
        while files is not None and files.hasNext():
            s = files.next()
            if s.getModificationTime() <= oldest and s.getPath().toString() not in named:
                gone += bool(self._fs.delete(s.getPath(), False))
        return gone


@dataclass
class Transaction:
    store: Store
    base: Snapshot
    tables: dict = field(init=False)
    meta: dict = field(init=False)

    def __post_init__(self):
        self.tables = json.loads(json.dumps(self.base.tables))
        self.meta = dict(self.base.meta)

    def _written(self, df: DataFrame, name: str, buckets: int) -> dict[str, list[str]]:
        """Writes rows with a column _bucket, a file for each bucket and task; their names by bucket. Rows are dealt by bucket, and a
        bucket that is larger than a task should read is dealt to several, so its files are many, but none is large."""
        folder = f"{self.store.root}/data/{name}/{uuid.uuid4().hex}"
        df.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(folder)
        out = {}
        for s in self.store._listed(folder):  # noqa: SLF001
            if s.isDirectory() and s.getPath().getName().startswith("_bucket="):
                inner = [x.getPath().toString() for x in self.store._listed(s.getPath().toString())]  # noqa: SLF001
                out[s.getPath().getName()[8:]] = sorted(x for x in inner if x.endswith(".parquet"))
        return out

    def now(self) -> Snapshot:
        """What this transaction would commit."""
        return Snapshot(self.store.spark, self.base.version, self.tables, self.meta)

    def replace(self, name: str, df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
        """A whole table, new or in place of one."""
        files = self._written(df.withColumn("_bucket", bucket_of(keys, buckets)), name, buckets)
        self.tables[name] = {"keys": keys, "buckets": buckets, "schema": df.schema.json(), "files": files}

    def _changed(self, name: str, rows: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Rewrites the buckets that rows (which have the key columns) fall into, as merged(old rows, rows) says."""
        own = self.tables[name]
        rows = cut(rows.withColumn("_bucket", bucket_of(own["keys"], own["buckets"])))
        touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())
        if touched:
            old = self.now().read(name, touched)
            new = merged(old, rows.drop("_bucket")).select(*old.columns).withColumn("_bucket", bucket_of(own["keys"], own["buckets"]))
            files = self._written(new, name, len(touched))
            own["files"] = {b: fs for b, fs in own["files"].items() if int(b) not in touched} | files
        return touched

    def upsert(self, name: str, rows: DataFrame, seq: str | None = None) -> list[int]:
        """Rows in place of those of their keys, the last by seq of each where keys repeat. Returns the buckets that were written."""
        keys = self.tables[name]["keys"]
        rows = latest(rows, keys, [seq]).drop(seq) if seq else rows
        return self._changed(name, rows, lambda old, new: old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns)))

    def delete(self, name: str, doomed: DataFrame) -> list[int]:
        """Takes out the rows with one of the keys."""
        keys = self.tables[name]["keys"]
        return self._changed(name, doomed.select(*keys).distinct(), lambda old, new: old.join(new, keys, "left_anti"))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows whose keys are new: files are added, none is read."""
        own = self.tables[name]
        files = self._written(rows.withColumn("_bucket", bucket_of(own["keys"], own["buckets"])), name, own["buckets"])
        own["files"] = {b: own["files"].get(b, []) + files.get(b, []) for b in {*own["files"], *files}}

    def commit(self, **meta) -> Snapshot:
        """Puts the next version, or raises Conflict. meta: notes for readers, beside those of the version before."""
        self.meta |= meta
        if not self.store.put(self.base.version + 1, {"tables": self.tables, "meta": self.meta}):
            raise Conflict(f"version {self.base.version + 1} is taken")
        return self.store.current(self.base.version + 1)
