"""Durable collections: an append-only table of operations and versioned snapshots.

Layout under ``path``::

    ops*/         Parquet files of (lsn, op, ext_id, vec, meta); a commit adds files
    snapshots/N/  state at a point: (ext_id, internal_id, vec, meta), and promoted metadata
    CURRENT       the version in force, the lsn up to which it holds, and the folder of the operations

``CURRENT`` is written aside and renamed over the old one, so that readers see the old version or the
new one.  The tail is what has a higher lsn; ops below may be removed at any time, or not at all.
What ``CURRENT`` does not name is not read: truncating writes the tail to a new folder, puts that in
force, and only then deletes the old one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators import oplog

OPS = f"lsn bigint, op int, ext_id string, vec array<float>, meta {oplog.META}"
STATE = f"ext_id string, internal_id bigint, vec array<float>, meta {oplog.META}"


class Blobs:
    """Small named files: whole or absent, whatever happens."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._at(name)
        return fs.exists(p)

    def put(self, name: str, data: bytes) -> None:
        """Write aside, then rename over the old file in one step; nothing is read before that."""
        fs, p = self._at(name)
        fs.mkdirs(p.getParent())
        _, aside = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, True)
        try:
            out.write(bytearray(data))
            out.hflush()
        finally:
            out.close()
        self._replace(aside, p)

    def _replace(self, source, target) -> None:
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        conf = self.spark._jsc.hadoopConfiguration()
        source, target = (p.getFileSystem(conf).makeQualified(p) for p in (source, target))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(source, target, how)

    def get(self, name: str) -> bytes:
        fs, p = self._at(name)
        if not fs.exists(p):
            raise FileNotFoundError(f"{self.path}/{name}")
        source = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def names(self) -> list[str]:
        """The names directly under the path."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, name: str) -> None:
        fs, p = self._at(name)
        fs.delete(p, True)


class OpStore:
    """The operations and snapshots of one collection; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.blobs = Blobs(spark, self.path)

    def _current(self) -> dict:
        said = json.loads(self.blobs.get("CURRENT")) if self.blobs.exists("CURRENT") else {}
        return {"version": 0, "lsn": 0, "ops": "ops", "promoted": {}} | said

    def current(self) -> tuple[int, int]:
        """``(version, lsn)`` in force; version 0 is the empty state."""
        said = self._current()
        return said["version"], said["lsn"]

    def ops(self) -> DataFrame:
        """All committed operations."""
        folder = self._current()["ops"]
        if not self.blobs.exists(folder):
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(f"{self.path}/{folder}")

    def tail(self) -> DataFrame:
        """Operations after the snapshot in force; the lsn filter reaches the scan."""
        return self.ops().where(F.col("lsn") > self.current()[1])

    def snapshot_state(self, promoted: Mapping[str, str] | None = None) -> DataFrame:
        """The snapshot in force, with the metadata keys of ``promoted`` as columns of their own.

        Keys that the snapshot was written with are columns of its files, others come from the map.
        """
        said, promoted = self._current(), dict(promoted or {})
        there = {k: c for k, c in promoted.items() if said["promoted"].get(k) == c}
        schema = ", ".join([STATE, *(f"`{c}` {oplog.META_VALUE}" for c in there.values())])
        if not said["version"]:
            state = self.spark.createDataFrame([], schema)
        else:
            state = self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{said['version']}")
        return oplog.promote(state, {k: c for k, c in promoted.items() if k not in there})

    def last_lsn(self) -> int:
        return self.tail().agg(F.max("lsn")).first()[0] or self.current()[1]

    def append(self, ops: DataFrame) -> None:
        """Commit operations that have their lsn; all of them become visible, or none."""
        ops.select("lsn", F.col("op").cast("int").alias("op"), "ext_id", F.col("vec").cast("array<float>").alias("vec"),
                   F.col("meta").cast(oplog.META).alias("meta")).write.mode("append").parquet(f"{self.path}/{self._current()['ops']}")

    def log(self) -> DataFrame:
        """Snapshot and tail as one log."""
        _, lsn = self.current()
        state = self.snapshot_state()
        return oplog.with_snapshot(state, lsn, self.tail())

    def publish(self, state: DataFrame, lsn: int, promoted: Mapping[str, str] | None = None) -> int:
        """Write ``state`` as the next snapshot, valid up to ``lsn``, and put it in force.

        The metadata keys of ``promoted`` are written as columns too, so that filters on them reach
        the scan.
        """
        said, promoted = self._current(), dict(promoted or {})
        version = said["version"] + 1
        rows = oplog.promote(state.select("ext_id", "internal_id", "vec", "meta"), promoted)
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/{version}")
        self.blobs.put("CURRENT", json.dumps(said | {"version": version, "lsn": lsn, "promoted": promoted}).encode())
        return version

    def truncate(self) -> None:
        """Drop operations that the snapshot in force holds, and older snapshots.

        A crash at any point leaves the old folder of operations in force, or the new one.
        """
        said = self._current()
        kept = self.ops().where(F.col("lsn") > said["lsn"])
        folder = f"ops-{uuid.uuid4().hex}"
        if kept.limit(1).count():
            kept.write.parquet(f"{self.path}/{folder}")
        self.blobs.put("CURRENT", json.dumps(said | {"ops": folder}).encode())
        for name in self.blobs.names():
            if (name.startswith("ops") and name != folder) or name.endswith(".tmp"):
                self.blobs.delete(name)
        for old in range(1, said["version"]):
            self.blobs.delete(f"snapshots/{old}")
