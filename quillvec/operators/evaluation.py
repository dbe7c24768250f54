"""Evaluation of searches: data, recall, percentiles, sweeps."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_vectors(n: int, dim: int, seed: int = 42) -> np.ndarray:
    """Elements uniform in [-1, 1]."""
    return np.random.default_rng(seed).uniform(-1, 1, (n, dim)).astype(np.float32)


def clustered_vectors(n: int, dim: int, clusters: int = 100, sigma: float = 0.1, seed: int = 42) -> np.ndarray:
    """Point i lies around uniform centroid i mod ``clusters``, with normal noise."""
    rng = np.random.default_rng(seed)
    centroids = rng.uniform(-1, 1, (clusters, dim))
    return (centroids[np.arange(n) % clusters] + rng.normal(0, sigma, (n, dim))).astype(np.float32)


def vector_table(spark: SparkSession, x: np.ndarray, id: str = "ext_id", vec: str = "vec") -> DataFrame:
    """``(id, vec)`` with ids ``v0, v1, ...``."""
    rows = [(f"v{i}", row.tolist()) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, f"{id} string, {vec} array<float>")


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, id: str = "ext_id") -> DataFrame:
    """One row ``recall``: mean over the queries of ``truth`` of hits / k."""
    hits = truth.select("qid", id).join(found.select("qid", id).distinct(), ["qid", id], "left_semi")
    per = truth.select("qid").distinct().join(hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid", "left")
    return per.agg(F.avg(F.coalesce("n", F.lit(0)) / F.lit(k)).alias("recall"))


def percentile_lower(df: DataFrame, value: str, fractions: Sequence[float]) -> DataFrame:
    """One row per fraction p: ``(p, value)``, the element floor(p * (n - 1)) of the sorted values.

    Nulls are left out.  Positions come from counts of distinct values, so no task holds all values.
    """
    from pyspark.sql import Window

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    from quillvec.session import written

    # Ranges of values; only their totals meet in one task.
    parts = written(counts.repartitionByRange("value").withColumn("_p", F.spark_partition_id()), "percentiles")
    totals = parts.groupBy("_p").agg(F.sum("n").alias("t"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.join(F.broadcast(offsets), "_p").withColumn("hi", F.col("_o") + F.sum("n").over(inside))
    total = totals.agg(F.sum("t").alias("total"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in fractions])).alias("p")
    wanted = total.select(asked, "total").select("p", F.floor(F.col("p") * (F.col("total") - 1)).alias("at"))
    return ends.join(F.broadcast(wanted), (F.col("at") < F.col("hi")) & (F.col("at") >= F.col("hi") - F.col("n"))).select("p", "value")


def sweep(values: Sequence[int], search: Callable[[int], DataFrame], truth: DataFrame, k: int, id: str = "ext_id") -> list[dict]:
    """Runs ``search`` for each setting; recall and seconds of each."""
    out = []
    for v in values:
        began = time.time()
        rows = search(v)
        recall = recall_at_k(rows, truth, k, id).first()["recall"]
        out.append({"setting": v, "recall": recall, "seconds": time.time() - began})
    return out


