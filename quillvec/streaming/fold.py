"""Structured Streaming over the operation log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.operators import oplog
from quillvec.sources.store import OPS


def read_ops(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the operations that are appended to a Parquet folder."""
    reader = spark.readStream.schema(OPS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def fold_stream(ops: DataFrame, dim: int | None = None) -> DataFrame:
    """The fold as a streaming aggregation: a row per changed key, ``live`` telling whether it lives.

    The registers are maxima over lsn, so late, shuffled and repeated operations need no watermark
    and no special case.  For output modes ``update`` and ``complete``.
    """
    state = oplog.accepted(ops, dim).groupBy("ext_id").agg(*oplog.registers(True))
    return state.select("ext_id", (F.coalesce(F.col("rop") == oplog.INSERT, F.lit(False))).alias("live"), "vec", "meta")


def effective_flags(op: np.ndarray) -> np.ndarray:
    """Whether each of a key's operations, in order of lsn, has an effect."""
    reset = np.where(op != oplog.UPDATE, np.arange(len(op)), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(reset)[:-1])) if len(op) else reset
    return (op == oplog.INSERT) | ((before >= 0) & (op[before] == oplog.INSERT))


def effects_stream(ops: DataFrame, dim: int | None = None) -> DataFrame:
    """``(lsn, op, ext_id, effective, revision)`` per operation, from keyed state; for output mode ``update``.

    Operations may come late and repeated, in any trigger.  A late operation can change whether later
    ones had an effect; those come out again with a higher ``revision``, so that the row with the
    highest revision of each ``(ext_id, lsn)`` (:func:`latest_effects`) is the effect as in a batch.
    A key's state holds nine bytes per operation.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lsn, op, was, revision = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int8), 0
        if state.exists:
            kept = state.get
            lsn, op = np.frombuffer(kept[0], np.int64), np.frombuffer(kept[1], np.int8)
            was, revision = effective_flags(op).astype(np.int8), kept[2]
        for rows in batches:
            more, first = np.unique(rows["lsn"].to_numpy(np.int64), return_index=True)
            new = ~np.isin(more, lsn)
            lsn = np.concatenate([lsn, more[new]])
            op = np.concatenate([op, rows["op"].to_numpy(np.int8)[first][new]])
            was = np.concatenate([was, np.full(int(new.sum()), -1, np.int8)])
        order = np.argsort(lsn, kind="stable")
        lsn, op, was = lsn[order], op[order], was[order]
        now = effective_flags(op)
        changed = now != was
        state.update((lsn.tobytes(), op.tobytes(), revision + 1))
        yield pd.DataFrame({"lsn": lsn[changed], "op": op[changed].astype(np.int32), "ext_id": key[0],
                            "effective": now[changed], "revision": np.int64(revision + 1)})

    rows = oplog.accepted(ops, dim).select("lsn", "op", "ext_id")
    return rows.groupBy("ext_id").applyInPandasWithState(
        step, "lsn bigint, op int, ext_id string, effective boolean, revision bigint",
        "lsn binary, op binary, revision bigint", "update", "NoTimeout",
    )


def latest_effects(saved: DataFrame) -> DataFrame:
    """``(lsn, op, ext_id, effective)`` from all rows that :func:`effects_stream` gave."""
    last = saved.groupBy("ext_id", "lsn").agg(F.max_by(F.struct("op", "effective"), "revision").alias("_e"))
    return last.select("lsn", "_e.op", "ext_id", "_e.effective")
