"""Byte logs and snapshots of operations as sources and sinks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.functions import codec
from quillvec.operators.oplog import META

RECORD = f"file string, record_no bigint, op int, ext_id string, vec array<float>, meta {META}"


def read(spark: SparkSession, path: str, snapshot: bool = False) -> DataFrame:
    """``(file, record_no, op, ext_id, vec, meta)`` of byte logs (or snapshots), a file per task row.

    A file is read up to its first torn or damaged record, without an error.  A record that is whole
    but no operation is one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                payloads = (codec.plain_frames if snapshot else codec.frames)(bytes(content))
                rows = []
                for n, payload in enumerate(payloads):
                    rows.append({"file": name, "record_no": n} | codec.decode(payload))
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows)

    return files.mapInPandas(run, RECORD)


def write(ops: DataFrame, path: str, snapshot: bool = False) -> None:
    """Write ``(lsn, op, ext_id, vec, meta)`` as byte logs in ``path``, ordered by lsn.

    Files are ranges of lsn, numbered in that order.  ``path`` is a URI of any file system that Arrow
    reaches; on a cluster it must be one that the executors share, so a path without scheme is refused
    there.
    """
    spark = ops.sparkSession
    if "://" not in path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name the shared file system of the path, as in hdfs://host/path")
        path = "file://" + os.path.abspath(path)
    ordered = ops.where("ext_id is not null").repartitionByRange("lsn").sortWithinPartitions("lsn")
    encoded = ordered.select(
        codec.encode_op(F.col("op"), F.col("ext_id"), F.col("vec"), F.col("meta")).alias("p"), F.spark_partition_id().alias("part")
    )

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out = target = aside = None
        count = 0
        for batch in batches:
            if out is None and batch.num_rows:
                target = f"{folder}/{batch.column(1)[0].as_py():06d}.log"
                aside = f"{target}.{uuid.uuid4().hex}.tmp"
                out = fs.open_output_stream(aside)
            for payload in batch.column(0).to_pylist():
                out.write(len(payload).to_bytes(4, "little") + payload if snapshot else codec.frame(payload))
                count += 1
        if out is not None:
            out.close()
            fs.move(aside, target)  # a task that runs twice leaves one whole file
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["n"])

    encoded.mapInArrow(save, "n bigint").agg(F.sum("n")).collect()
