"""Live vectors of an operation log as unit vectors, in a compact written table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillvec.operators import oplog
from quillvec.session import written

DIM = 48  # of this project's vectors


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a binary column as a float32 matrix, without copying."""
    if len(column) == 0:
        return np.zeros((0, dim), np.float32)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float32).reshape(len(column), dim)


def binary(rows: np.ndarray) -> pa.Array:
    """A float32 matrix as a binary column, a row per value."""
    rows = np.ascontiguousarray(rows, np.float32)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unit_vectors(state: DataFrame, key: str, vec: str, dim: int = DIM) -> DataFrame:
    """``(key, v binary)``: ``vec`` scaled to length 1 as float32; an all-zero vector stays zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = values.reshape(-1, dim)
            length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            unit = np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(unit)], [key, "v"])

    kind = state.schema[key].dataType.simpleString()
    valid = state.where(oplog.valid_vector(state[vec], dim))
    return valid.select(key, vec).mapInArrow(run, f"{key} {kind}, v binary")


def live_units(op_log: DataFrame, dim: int = DIM) -> DataFrame:
    """Written table ``(ext_id, v)`` of the live records of a log."""
    state = oplog.fold(op_log.select("lsn", "op", "ext_id", "vec"), dim, with_meta=False)
    # The fold has validated the vectors, and a live key has one.
    return written(unit_vectors(state, "ext_id", "vec", dim), "units")
