"""Session helpers: the shared work folder and tables written into it."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can read and write.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that setting is absent (local
    tests) a temporary folder of this machine is used, and remembered in the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    kept = spark.conf.get("quillvec.work.dir", None)
    if not kept:
        kept = "file://" + tempfile.mkdtemp(prefix="quillvec-")
        spark.conf.set("quillvec.work.dir", kept)
    return kept


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders per value of ``by`` if given, and read it back.

    The written table cuts the lineage, survives the loss of executors, is computed once however
    often it is read, and keeps column pruning.  It is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillvec/{name}-{uuid.uuid4().hex}"
    out = df.write.mode("errorifexists").option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of every query as soon as it ends, not when the driver collects its garbage.

    For steps that write what they make: no later query reads those files.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Mark ``df`` for broadcasting only if it is proven to have at most ``max_rows`` rows.

    Otherwise it is returned as it is, and the planner joins it with a shuffle.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per Spark context."""
    import shutil

    context = spark.sparkContext
    if not getattr(context, "_quillvec_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="quillvec-package-")
        base = os.path.join(folder, "quillvec")
        archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._quillvec_shipped = True
    return spark
