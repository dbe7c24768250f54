"""Exact filtered k-nearest-neighbour search, for one query and for many.

Results are ordered by ``(score, id)``, so ties have a defined order.  Three kernels give the same
ranking, but for scores that differ by rounding only:

* ``expr``: column expressions over the rows and a broadcast table of at most ``FEW_QUERIES`` queries;
  bit-equal to other engines that add in element order;
* ``scan``: a block of at most ``PASS_QUERIES`` queries is broadcast, every task scores its rows
  against it by matrix products and returns its k best per query; the rows are not shuffled.  More
  queries take more passes, up to ``PASSES``;
* ``blocks``: rows and queries are dealt into blocks, and every pair of blocks is scored as one
  matrix product; each pair returns k candidates per query.  Neither side is broadcast or gathered,
  so both may grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from quillvec.config import Metric
from quillvec.functions import distance as D
from quillvec.operators.oplog import valid_vector
from quillvec.session import written

FEW_QUERIES = 32
PASS_QUERIES, PASSES = 10_000, 20
PASS_RESULTS = 5_000_000  # queries of a pass times k, at most
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 4_096


def clean_queries(queries: DataFrame, dim: int, qid: str = "qid", qv: str = "qv") -> DataFrame:
    """``(qid, qv)`` of the valid queries, one per ``qid``.

    Queries with a null id, or a vector that is null, of another size or not finite, are left out;
    of several vectors for one id the least holds.
    """
    valid = queries.where(F.col(qid).isNotNull() & valid_vector(F.col(qv), dim))
    return valid.groupBy(F.col(qid).alias("qid")).agg(F.min(F.col(qv)).alias("qv"))


def knn_single(
    vectors: DataFrame, query: list[float], k: int, metric: Metric | str = Metric.COSINE, id: str = "ext_id", vec: str = "vec"
) -> DataFrame:
    """``(id, score)`` of the k rows nearest to one query: a top-k that never sorts all rows."""
    point = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.where(F.col(vec).isNotNull()).select(id, D.distance(metric, F.col(vec), point).alias("score"))
    return scored.orderBy("score", id).limit(max(0, k))


def _ranked(scored: DataFrame, k: int, id: str) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("score", id)
    return scored.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= k).select(
        "qid", "rank_no", id, "score"
    )


def knn(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    metric: Metric | str = Metric.COSINE,
    id: str = "ext_id",
    vec: str = "vec",
    kernel: str = "auto",
) -> DataFrame:
    """``(qid, rank_no, id, score)``: the k nearest rows of each query of ``(qid, qv)``.

    k = 0 gives no rows, a k above the number of rows gives all of them.  Rows without a vector are
    left out; differing sizes are an error.  Filter ``vectors`` beforehand: a filter on typed columns
    reaches the Parquet scan.
    """
    rows = vectors.where(F.col(vec).isNotNull())
    if k <= 0:
        kind = f"qid {dict(queries.dtypes)['qid']}, rank_no int, {id} {dict(vectors.dtypes)[id]}, score double"
        return vectors.sparkSession.createDataFrame([], kind)
    if kernel in ("auto", "scan"):
        size = pass_size(k)
        first = queries.select("qid", "qv").limit(size + 1).toArrow()
        if first.num_rows <= size and (kernel == "scan" or first.num_rows > FEW_QUERIES):
            return _ranked(scan(rows, first, k, Metric(metric), id, vec), k, id)
        if first.num_rows > size:
            passes = -(-queries.count() // size) + 1
            if kernel == "scan" or passes <= PASSES:
                dealt = written(queries.select("qid", "qv", F.pmod(F.xxhash64("qid"), F.lit(passes)).alias("_b")), "queries")
                parts = [dealt.where(F.col("_b") == b).drop("_b").toArrow() for b in range(passes)]  # a pass at a time
                scanned = [scan(rows, p, k, Metric(metric), id, vec) for p in parts]
                return _ranked(reduce(DataFrame.unionByName, scanned), k, id)
            kernel = "blocks"
    if kernel == "blocks":
        return _ranked(_blocks(rows, queries, k, Metric(metric), id, vec), k, id)
    asked = queries.select("qid", F.col("qv").alias("_q"))
    base = rows.select(F.col(id), F.col(vec).alias("_v"))
    if Metric(metric) is Metric.COSINE:  # norms once per row and query, not per pair
        asked = asked.withColumn("_nq", D.norm(F.col("_q")))
        base = base.withColumn("_nv", D.norm(F.col("_v")))
        score = F.when(
            F.size("_v") == F.size("_q"),
            D.cosine_from(D.inner(F.col("_v"), F.col("_q")), F.col("_nv"), F.col("_nq")),
        ).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))
    else:
        score = D.distance(metric, F.col("_v"), F.col("_q"))
    pairs = base.crossJoin(F.broadcast(asked))  # a stated, bounded set of queries
    return _ranked(pairs.select("qid", id, score.alias("score")), k, id)


def _dense(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in size")
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def top_k(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least scores of each row, ties by the order of ``ids``."""
    n = min(k, scores.shape[1])
    if n < scores.shape[1]:
        # All that reach the k-th score, so that ties at the edge are decided by id.
        # A first bound from the best of each of several strides spares most of the partition.
        width = scores.shape[1]
        if width >= 64 * n:
            best = scores[:, : width - width % (4 * n)].reshape(len(scores), -1, 4 * n).min(axis=1)
            bound = np.partition(best, n - 1, axis=1)[:, n - 1]
        else:
            bound = np.partition(scores, n - 1, axis=1)[:, n - 1]
        row, col = np.nonzero(scores <= bound[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), scores.shape[1])
    order = np.lexsort((ids[col], scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], col[keep]


def pass_size(k: int) -> int:
    """Queries that are broadcast at once."""
    return max(1, min(PASS_QUERIES, PASS_RESULTS // max(1, k)))


def scan(
    rows: DataFrame, queries: pa.Table, k: int, metric: Metric, id: str, vec: str,
    probes: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """``(qid, id, score)``: of each task's rows, the k nearest to each of the bounded ``queries``.

    With ``probes`` (prepared queries, centroids, radius of each query) the rows have a ``cell``, and
    a query meets the cells whose centroid is within its radius.
    """
    spark = rows.sparkSession
    qids = queries.column("qid").combine_chunks()
    qv = _dense(queries.column("qv"))
    shared = spark.sparkContext.broadcast((qv, probes))  # at most PASS_QUERIES vectors, and the centroids
    id_kind, qid_type = dict(rows.dtypes)[id], qids.type

    def best(out: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        q, score = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
        ids = pa.concat_arrays([o[2] for o in out])
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, score, q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < k]
        return q[order], score[order], ids.take(pa.array(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qv, probes = shared.value
        kept: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows or not len(qv):
                continue
            ids, x = batch.column(0), _dense(batch.column(1))
            if x.shape[1] != qv.shape[1]:
                raise ValueError("vectors differ in size")
            groups = [(np.arange(len(x)), None)]
            if probes is not None:
                asked, centroids, radius = probes
                cells = batch.column(2).to_numpy()
                order = np.argsort(cells, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(cells[order]) != 0)))
                groups = []
                for part in np.split(order, starts[1:]):
                    far = ((asked - centroids[cells[part[0]]]) ** 2).sum(axis=1)
                    groups.append((part, np.flatnonzero(far <= radius)))
            for part, who in groups:
                place = np.empty(len(part), np.int64)
                own = ids if len(part) == len(ids) and who is None else ids.take(pa.array(part))
                place[pa.compute.sort_indices(own).to_numpy()] = np.arange(len(part))
                mine = x if len(part) == len(x) and who is None else x[part]
                number = len(qv) if who is None else len(who)
                for at in range(0, number, 256):
                    those = np.arange(at, min(number, at + 256)) if who is None else who[at : at + 256]
                    scores = D.matrix(metric, qv[those], mine)
                    row, col = top_k(scores, place, k)
                    kept.append((those[row], scores[row, col], own.take(pa.array(col))))
                    held += len(row)
            if held > 4 * max(100_000, len(qv) * k):
                kept = [best(kept)]
                held = len(kept[0][0])
        if kept:
            q, score, ids = best(kept)
            for at in range(0, len(q), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q[part])), ids[part], pa.array(score[part])], ["qid", id, "score"])

    columns = [F.col(id), F.col(vec), *([F.col("cell")] if probes is not None else [])]
    kind = from_arrow_type(qid_type).simpleString()
    return rows.select(*columns).mapInArrow(run, f"qid {kind}, {id} {id_kind}, score double")


def pair_scorer(metric: Metric, id: str, k: int):
    """Function from a block of rows ``(_id, _v)`` and queries ``(_qid, _v)`` to each query's k best."""

    def pair(part):
        mine = part.filter(part.column("_qid").is_valid())
        theirs = part.filter(part.column("_qid").is_null())
        queries_, rows_ = _dense(mine.column("_v")), _dense(theirs.column("_v"))
        ids, qids = theirs.column("_id").combine_chunks(), mine.column("_qid").combine_chunks()
        if not len(queries_) or not len(rows_):
            return pa.table({"qid": qids.slice(0, 0), id: ids.slice(0, 0), "score": pa.array([], pa.float64())})
        place = np.empty(len(ids), np.int64)
        place[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        out = []
        for at in range(0, len(queries_), 256):
            scores = D.matrix(metric, queries_[at : at + 256], rows_)
            row, col = top_k(scores, place, k)
            out.append((row + at, col, scores[row, col]))
        row, col, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"qid": qids.take(pa.array(row)), id: ids.take(pa.array(col)), "score": pa.array(score)})

    return pair


def _blocks(rows: DataFrame, queries: DataFrame, k: int, metric: Metric, id: str, vec: str) -> DataFrame:
    kinds = {dict(rows.dtypes)[vec], dict(queries.dtypes)["qv"]}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"  # as it comes; scored in double
    base = rows.select(F.col(id).alias("_id"), F.col(vec).cast(kind).alias("_v"))
    asked = queries.select(F.col("qid").alias("_qid"), F.col("qv").cast(kind).alias("_v"))
    nr, total = max(1, -(-base.count() // BLOCK_ROWS)), asked.count()
    # As many pairs of blocks as there are cores, if there are queries enough to share out.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    nq = max(1, -(-total // BLOCK_QUERIES), min(-(-cores // nr), total // 64))
    spread = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    id_kind, qid_kind = dict(rows.dtypes)[id], dict(queries.dtypes)["qid"]
    left = base.select(
        spread("_id", nr).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"),
        "_id", F.lit(None).cast(qid_kind).alias("_qid"), "_v",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(nr - 1))).alias("r"), spread("_qid", nq).alias("q"),
        F.lit(None).cast(id_kind).alias("_id"), "_qid", "_v",
    )

    scorer = pair_scorer(metric, id, k)
    return left.unionByName(right).groupBy("r", "q").applyInArrow(scorer, f"qid {qid_kind}, {id} {id_kind}, score double")
