"""Approximate search over cells (an inverted file).

Centroids are fitted on a bounded sample of ``SAMPLE`` rows; every row is assigned to its nearest
cell and written in files of that cell, so that a search reads only the cells it probes.  A query
probes the nearest cells until they hold ``factor * max(ef, k)`` rows that pass the filter and no less
than a share of those rows, and compares their rows exactly; probing all cells is exact search.  The
share is measured when the index is built: the exact neighbours of ``ASKED`` rows tell how far probing
must go for the recall ``params.recall``.  Cosine normalises rows before they are assigned.  The inner
product is no metric, so it probes all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.config import AnnParams, Metric
from quillvec.operators.search import BLOCK_QUERIES, BLOCK_ROWS, _dense, _ranked, pair_scorer, pass_size, scan
from quillvec.session import shared_dir, written

SAMPLE = 65_536
MAX_CELLS = 65_536
FLAT_CELLS = 1024  # more cells are fitted in two levels
BLOCK_CELLS = 1 << 22  # distances to centres that are held at once
ASKED = 128  # rows whose exact neighbours calibrate the probed share
DEPTH = 512  # neighbours of each


def _prepared(x: np.ndarray, metric: Metric) -> np.ndarray:
    if metric is not Metric.COSINE:
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def fit_centroids(x: np.ndarray, cells: int, params: AnnParams) -> np.ndarray:
    """Centroids of sample rows by k-means; fewer than ``cells`` if there are fewer rows.

    Many cells are fitted in two levels: groups of rows, then cells of each group in proportion.
    """
    rng = np.random.default_rng(params.seed)
    if cells > FLAT_CELLS and len(x) > cells:
        coarse = fit_centroids(x, int(np.sqrt(cells)), params)
        label = _nearest(x, coarse)
        parts = [x[label == g] for g in range(len(coarse))]
        return np.concatenate([fit_centroids(p, max(1, round(cells * len(p) / len(x))), params) for p in parts if len(p)])
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(params.iterations):
        label = _nearest(x, centres)
        count = np.bincount(label, minlength=len(centres)).astype(float)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        filled = count > 0
        centres[filled] = sums[filled] / count[filled][:, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in blocks of at most ``BLOCK_CELLS`` distances."""
    half = (centres * centres).sum(axis=1)[None] / 2
    step = max(1, BLOCK_CELLS // len(centres))
    parts = [(half - x[at : at + step] @ centres.T).argmin(axis=1) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass(frozen=True)
class CellIndex:
    """An index: its centroids, and the rows with their ``cell``."""

    centroids: np.ndarray
    rows: DataFrame  # the indexed table and its column ``cell``
    metric: Metric
    params: AnnParams
    id: str
    vec: str
    total: int  # rows
    counts: np.ndarray  # rows of each cell
    reach: np.ndarray  # per calibrating row and neighbour: share of the rows in cells nearer than the neighbour's

    def share(self, k: int, kept: int) -> float:
        """Share of the rows to probe for ``k`` neighbours among the ``kept`` rows that a filter lets through.

        The k-th neighbour among those is about the ``k * total / kept``-th among all.
        """
        depth = max(1, -(-k * self.total // max(1, kept)))
        if depth > self.reach.shape[1] or not len(self.reach):
            return 1.0
        return float(np.quantile(self.reach[:, :depth], self.params.recall, method="higher"))

    def stats(self) -> DataFrame:
        """``(cell, size)`` of each cell that holds rows."""
        return self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))


def build(
    vectors: DataFrame,
    metric: Metric | str = Metric.COSINE,
    params: AnnParams = AnnParams(),
    id: str = "ext_id",
    vec: str = "vec",
    path: str | None = None,
) -> CellIndex:
    """Index all rows of ``vectors`` that have a vector; other columns stay usable in filters."""
    import uuid

    metric, spark = Metric(metric), vectors.sparkSession
    rows = vectors.where(F.col(vec).isNotNull())
    total = rows.count()
    hashed = F.xxhash64(id).bitwiseAND(F.lit(2**31 - 1))
    limit = int(min(1.0, 1.3 * SAMPLE / max(1, total)) * (2**31 - 1))
    sample = rows.where(hashed <= limit).orderBy(hashed, id).limit(SAMPLE).select(id, vec).toArrow()
    x = _prepared(_dense(sample.column(vec)), metric) if sample.num_rows else np.zeros((0, 1))
    cells = min(MAX_CELLS, params.cells or max(1, int(np.sqrt(total))))
    centroids = fit_centroids(x, cells, params) if len(x) else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def cell_of(column: pd.Series) -> pd.Series:
        if not len(column):
            return pd.Series([], dtype="int32")
        return pd.Series(_nearest(_prepared(np.stack(column.to_numpy()).astype(np.float64), metric), shared.value))

    place = path or f"{shared_dir(spark)}/quillvec/cells-{uuid.uuid4().hex}"
    assigned = rows.withColumn("cell", cell_of(F.col(vec)))
    # Balanced at run time: a cell with much of the rows is split, small cells share a task.
    assigned.hint("rebalance", "cell").write.partitionBy("cell").parquet(place)
    schema = assigned.schema
    made = spark.read.schema(schema).parquet(place) if total else assigned
    calibrated = metric is not Metric.DOT and total > 1
    counts = _counts(made, len(centroids))
    own = sample.column(id).slice(0, ASKED).to_pylist()
    reach = _reach(made, own, x[:ASKED], centroids, counts, metric, id, vec, total) if calibrated else np.ones((0, 0))
    return CellIndex(centroids, made, metric, params, id, vec, total, counts, reach)


def _counts(rows: DataFrame, cells: int) -> np.ndarray:
    """The rows of each cell."""
    counted = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= MAX_CELLS
    return np.array([counted.get(c, 0) for c in range(cells)])


def _reach(
    rows: DataFrame, own: list, asked: np.ndarray, centroids: np.ndarray, counts: np.ndarray, metric: Metric, id: str, vec: str, total: int
) -> np.ndarray:
    """Share of the rows in cells nearer than that of each exact neighbour of the ``asked`` rows, nearest first.

    One pass over ``rows``; a task returns at most ``DEPTH`` rows per asked row.
    """
    depth = min(DEPTH, total - 1)
    nearer = np.zeros((len(asked), len(centroids)))
    for i, a in enumerate(asked):
        order = np.argsort(((centroids - a) ** 2).sum(axis=1), kind="stable")
        nearer[i, order] = (np.cumsum(counts[order]) - counts[order]) / total
    shared = rows.sparkSession.sparkContext.broadcast((asked, own, nearer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, own, nearer = shared.value
        best = [(np.zeros(0), np.zeros(0))] * len(asked)
        for batch in batches:
            if not len(batch):
                continue
            x = _prepared(np.stack(batch["v"].to_numpy()).astype(np.float64), metric)
            far = (x * x).sum(axis=1)[None] - 2 * (asked @ x.T)
            ids, cells = batch["id"].to_numpy(), batch["cell"].to_numpy()
            for i, key in enumerate(own):
                keep = ids != key
                f, s = np.append(best[i][0], far[i][keep]), np.append(best[i][1], nearer[i][cells[keep]])
                if len(f) > depth:
                    top = np.argpartition(f, depth - 1)[:depth]
                    f, s = f[top], s[top]
                best[i] = f, s
        for i, (f, s) in enumerate(best):
            yield pd.DataFrame({"i": np.full(len(f), i, np.int32), "far": f, "share": s})

    found = rows.select(F.col(id).alias("id"), F.col(vec).alias("v"), "cell").mapInPandas(run, "i int, far double, share double")
    nearest = Window.partitionBy("i").orderBy("far", "share")
    top = found.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= depth).select("i", "n", "share")
    reach = np.ones((len(asked), depth))
    for r in top.collect():  # <= ASKED * DEPTH
        reach[r["i"], r["n"] - 1] = r["share"]
    return reach


def search(
    index: CellIndex, queries: DataFrame, k: int, allowed: Column | None = None, ef: int | None = None, all_cells: bool = False
) -> DataFrame:
    """``(qid, rank_no, id, score)`` like exact search, from the cells each query probes.

    ``allowed`` filters the rows before cells are chosen, so a selective filter widens the probe.
    """
    spark = index.rows.sparkSession
    rows = index.rows if allowed is None else index.rows.where(allowed)
    id_kind, qid_kind = dict(rows.dtypes)[index.id], dict(queries.dtypes)["qid"]
    if k <= 0 or not index.total:
        return spark.createDataFrame([], f"qid {qid_kind}, rank_no int, {index.id} {id_kind}, score double")
    # A filter is counted without reading vectors; without one the counts are those of the index.
    counts = index.counts if allowed is None else _counts(rows, len(index.centroids))
    kept = int(counts.sum())
    # Cells are probed while those nearer hold fewer rows than wanted.
    wanted = max(index.params.factor * max(ef or index.params.ef, k), int(index.share(k, kept) * kept) + 1)
    everything = all_cells or index.metric is Metric.DOT
    metric = index.metric
    size = pass_size(k)
    first = queries.select("qid", F.col("qv").cast("array<double>").alias("qv")).limit(size + 1).toArrow()
    if first.num_rows <= size:
        asked = _prepared(_dense(first.column("qv")), metric) if first.num_rows else np.zeros((0, index.centroids.shape[1]))
        radius, met = np.full(len(asked), np.inf), np.zeros(len(counts), bool)
        if everything or not len(asked):
            met[:] = True
        else:
            step = max(1, BLOCK_CELLS // len(counts))
            for at in range(0, len(asked), step):
                q = asked[at : at + step]
                far = ((q * q).sum(axis=1)[:, None] + (index.centroids**2).sum(axis=1)[None] - 2 * (q @ index.centroids.T))
                order = np.argsort(far, axis=1, kind="stable")
                last = (np.cumsum(counts[order], axis=1) < wanted).sum(axis=1).clip(max=len(counts) - 1)
                edge = np.take_along_axis(far, np.take_along_axis(order, last[:, None], 1), 1)
                radius[at : at + step] = edge[:, 0] + 1e-9 * (1 + abs(edge[:, 0]))
                met |= (far <= radius[at : at + step, None]).any(axis=0)
        probed = np.flatnonzero(met & (counts > 0)).tolist()
        if len(probed) < len(counts) // 2:
            rows = rows.where(F.col("cell").isin(probed))
        return _ranked(scan(rows, first, k, metric, index.id, index.vec, (asked, index.centroids, radius)), k, index.id)
    shared = spark.sparkContext.broadcast((index.centroids, counts))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, counts = shared.value
        for batch in batches:
            cells = []
            for q in batch["qv"]:
                order = np.flatnonzero(counts > 0)
                if not everything:
                    x = _prepared(np.asarray(q, np.float64)[None], metric)
                    far = ((centroids - x) ** 2).sum(axis=1)
                    order = np.argsort(far, kind="stable")
                    order = order[: int(np.searchsorted(np.cumsum(counts[order]), wanted)) + 1]
                    order = order[counts[order] > 0]
                cells.append(order.astype(np.int32))
            yield pd.DataFrame({"qid": batch["qid"], "qv": batch["qv"], "cells": cells})

    kind = f"qid {qid_kind}, qv array<double>, cells array<int>"
    probes = queries.select("qid", F.col("qv").cast("array<double>").alias("qv")).mapInPandas(probe, kind)
    visits = written(probes.select("qid", "qv", F.explode("cells").alias("cell")), "visits")
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= MAX_CELLS
    # Cells that need more than one block of rows or queries; every query meets all blocks of a cell.
    blocks = [
        (c, -(-int(counts[c]) // BLOCK_ROWS), -(-n // BLOCK_QUERIES))
        for c, n in asked.items() if counts[c] > BLOCK_ROWS or n > BLOCK_QUERIES
    ]
    hot = F.broadcast(spark.createDataFrame(blocks, "cell int, rb int, qb int"))  # <= MAX_CELLS rows
    rb, qb = F.coalesce("rb", F.lit(1)), F.coalesce("qb", F.lit(1))
    spread = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = rows.where(F.col("cell").isin(list(asked)) if len(asked) < len(counts) // 2 else F.lit(True)).join(hot, "cell", "left").select(
        "cell", spread(index.id, rb).alias("r"), F.explode(F.sequence(F.lit(0), qb - 1)).alias("q"),
        F.col(index.id).alias("_id"), F.lit(None).cast(qid_kind).alias("_qid"), F.col(index.vec).cast("array<double>").alias("_v"),
    )
    right = visits.join(hot, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0), rb - 1)).alias("r"), spread("qid", qb).alias("q"),
        F.lit(None).cast(id_kind).alias("_id"), F.col("qid").alias("_qid"), F.col("qv").alias("_v"),
    )
    scored = left.unionByName(right).groupBy("cell", "r", "q").applyInArrow(
        pair_scorer(metric, index.id, k), f"qid {qid_kind}, {index.id} {id_kind}, score double"
    )
    return _ranked(scored, k, index.id)
