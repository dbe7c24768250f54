"""Choosing a varied subset (problem 2).

From the live vectors: mini-batch k-means, quotas that grow with the square root of a cluster's
size, and a sample within each quota.  The records are dealt into ``BATCHES`` mini-batches by a
hash of their id.  Each batch moves the centres by a step that shrinks with the records a centre
has seen, so that every record takes part once.  The number of centres grows with the square root of
the records; they start from the groups of a sample.  Where k-means cuts a large group into several
clusters, these overlap and are joined, nearest first, on their measured counts, means and spreads.  A joined cluster is
measured as a whole, so a chain of groups that lie apart does not become one.  Then all records are
assigned and counted.  Slots that a cluster cannot fill go to the others.

From a query's retrieved rows: the clusters are the documents, with equal quotas.  Every document
gets one slot in turn, best rank first, until the slots are used, so the slots of short documents
pass on by themselves.  A row whose text repeats that of a better row is taken only when no other
is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.clusters import _added, _distinct, _moments, divided, unit
from quillvec.llm.neardup import normalised
from quillvec.llm.vectors import DIM, live_units, matrix
from quillvec.session import written

CLUSTERS, MOST_CLUSTERS = 64, 1024  # centres: half the square root of the records, within these
# Two clusters are one group if the distance of their means is at most this many times the sum of their standard
# deviations in its direction (the halves of a normal group have 1.3), or of their whole spreads (small pieces of one
# group in many dimensions are far from each other in every single direction, but not for their spread).
OVERLAP, WHOLE_OVERLAP = 1.6, 0.35
DRAWN = 1.3  # or this many times as far as the mean of so many records drawn from the other group is from its mean
BATCHES = 8
COVERED = 1.7  # times the mean square distance within a group
CLUMPED = 0.15  # least share of that distance at which the nearest other member of a group without clumps is
START_ROWS = 8192  # rows that the starting centres are chosen from, at most


def quotas(sizes: dict[int, int], slots: int) -> dict[int, int]:
    """Slots per cluster in proportion to the square root of its size, never above its size.

    Every cluster gets one first, if there are enough.  Largest remainders first (ties to the lower
    cluster); what does not fit is dealt out again.
    """
    given = dict.fromkeys(sizes, int(slots >= len(sizes)))
    left = min(slots, sum(sizes.values())) - sum(given.values())
    while left:
        open_ = {c: n for c, n in sizes.items() if given[c] < n}
        weight = {c: np.sqrt(n) for c, n in open_.items()}
        total = sum(weight.values())
        share = {c: left * w / total for c, w in weight.items()}
        take = {c: min(int(share[c]), open_[c] - given[c]) for c in open_}
        over = left - sum(take.values())
        for c in sorted(open_, key=lambda c: (int(share[c]) - share[c], c)):
            if over and take[c] < open_[c] - given[c]:
                take[c] += 1
                over -= 1
        for c, n in take.items():
            given[c] += n
            left -= n
    return given


def _start(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centres: the means of the groups among ``rows``, then records far from all (k-means++).

    The groups are the compact leaves of bisecting k-means, so that a large group isn't cut into many.
    """
    centres = [(s / n).astype(np.float32) for n, s in sorted(divided(rows, len(rows)), key=lambda g: -g[0])]
    centres = [centres[i] for i in _distinct([unit(c) for c in centres])]
    far = np.full(len(rows), np.inf, np.float32)
    for c in centres:
        # Unit vectors: a group's mean square distance from its mean c is 1 - |c|^2.  What lies so near needs no
        # other centre, unless the group is made of clumps: its members' nearest others are far nearer than that.
        away = ((rows - c) ** 2).sum(axis=1)
        spread = 1 - float(c @ c)
        within = np.flatnonzero(away <= COVERED * spread + 1e-6)
        some = rows[rng.permutation(within)[:512]]
        if len(some) > 2:
            cosine = some @ some.T
            np.fill_diagonal(cosine, -1)
            if np.median(1 - cosine.max(axis=1)) >= CLUMPED * spread or spread < 0.05:
                away[within] = 0
        far = np.minimum(far, away)
    if not centres:
        centres = [rows[rng.integers(len(rows))]]
        far = ((rows - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and far.max() > 1e-9:
        centres.append(rows[rng.choice(len(rows), p=far / far.sum(dtype=np.float64))])
        far = np.minimum(far, ((rows - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres, np.float32)


def fit_centres(batches: DataFrame, dim: int, k: int = CLUSTERS, seed: int = 2) -> np.ndarray:
    """Centres of ``(batch, v)`` by mini-batch k-means, one batch per pass."""
    rng = np.random.default_rng(seed)
    first = batches.where("batch >= 0").orderBy("h").limit(START_ROWS).select("v").toArrow()
    parts = [matrix(b.column(0), dim) for b in first.combine_chunks().to_batches()]
    rows = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
    if len(rows) == 0:
        return np.zeros((1, dim), np.float32)
    centres = _start(rows, k, rng)
    seen = np.zeros(len(centres))
    for number in range(BATCHES):
        now = centres.copy()

        def run(parts: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros((len(now), dim)), np.zeros(len(now), np.int64)
            for part in parts:
                x = matrix(part.column(0), dim)
                label = nearest(x, now)
                count += np.bincount(label, minlength=len(now))
                np.add.at(sums, label, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(now)), dim), pa.int32()), pa.array(np.tile(np.arange(dim), len(now)), pa.int32()),
                 pa.array(sums.ravel()), pa.array(np.repeat(count, dim))],
                ["c", "d", "s", "n"],
            )

        added = (
            batches.where(F.col("batch") == number).select("v").mapInArrow(run, "c int, d int, s double, n bigint")
            .groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        )  # clusters times dimensions
        sums, count = np.zeros((len(centres), dim)), np.zeros(len(centres))
        for r in added:
            sums[r["c"], r["d"]] = r["s"]
            count[r["c"]] = r["n"]
        moved = count > 0
        seen += count
        rate = np.divide(count, seen, out=np.zeros_like(count), where=seen > 0)[:, None]
        mean = np.divide(sums, count[:, None], out=np.zeros_like(sums), where=count[:, None] > 0)
        centres = np.where(moved[:, None], centres + rate * (mean - centres), centres).astype(np.float32)
    return centres


def centres_for(records: int) -> int:
    """The number of centres for so many records."""
    return int(min(MOST_CLUSTERS, max(CLUSTERS, np.sqrt(records) / 2)))


def joined(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], number: int) -> np.ndarray:
    """The group of each of ``number`` clusters, from their ``(count, sum, second moments)``.

    The two groups with the least distance in terms of their spread are joined, until none is within
    :data:`OVERLAP`, :data:`WHOLE_OVERLAP` or :data:`DRAWN`.  Clusters without records keep to themselves.
    """
    group = np.arange(number)
    own = {k: m for k, m in moments.items() if m[0] > 0}
    mean = {k: s / n for k, (n, s, _) in own.items()}
    cov = {k: q / n - np.outer(s / n, s / n) for k, (n, s, q) in own.items()}

    def apart(a: int, others: list[int]) -> np.ndarray:
        d = np.array([mean[o] for o in others]) - mean[a]
        far = np.linalg.norm(d, axis=1)
        u = d / np.maximum(far, 1e-12)[:, None]
        one = np.sqrt(np.maximum(np.einsum("nd,de,ne->n", u, cov[a], u), 0))
        two = np.sqrt(np.maximum(np.einsum("nd,nde,ne->n", u, np.array([cov[o] for o in others]), u), 0))
        mine = np.sqrt(max(np.trace(cov[a]), 0))
        theirs = np.sqrt(np.maximum([np.trace(cov[o]) for o in others], 0))
        drawn = np.maximum(mine / np.sqrt([own[o][0] for o in others]), theirs / np.sqrt(own[a][0]))
        reach = np.maximum(np.maximum(OVERLAP * (one + two), WHOLE_OVERLAP * (mine + theirs)), DRAWN * drawn)
        return np.where(far < 1e-9, 0.0, far / np.maximum(reach, 1e-12))  # up to 1 they are joined

    heap = []
    keys = sorted(own)
    for i, a in enumerate(keys[:-1]):
        heap += [(float(r), a, b, 0, 0) for b, r in zip(keys[i + 1 :], apart(a, keys[i + 1 :])) if r <= 1]
    heapq.heapify(heap)
    version = dict.fromkeys(keys, 0)
    while heap:
        _, a, b, va, vb = heapq.heappop(heap)
        if version.get(a) != va or version.get(b) != vb:
            continue
        n, s, q = (x + y for x, y in zip(own[a], own.pop(b)))
        own[a], mean[a], cov[a] = (n, s, q), s / n, q / n - np.outer(s / n, s / n)
        version[a] += 1
        del version[b]
        group[group == b] = a
        others = [o for o in own if o != a]
        for o, r in zip(others, apart(a, others) if others else []):
            if r <= 1:
                x, y = min(a, o), max(a, o)
                heapq.heappush(heap, (float(r), x, y, version[x], version[y]))
    return group


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)).argmin(axis=1)


def from_vectors(op_log: DataFrame, sizes: list[tuple[int, int]], dim: int = DIM) -> DataFrame:
    """``(request_id, ext_id, cluster, cluster_size)``: a varied subset of live records per request.

    All-zero vectors are a cluster of their own, numbered -1.  A subset size above the number of
    records takes all; a size that is null or not positive takes none.
    """
    spark = op_log.sparkSession
    kind = "request_id int, ext_id string, cluster int, cluster_size bigint"
    wanted = [(r, n) for r, n in sizes if r is not None and n and n > 0]
    if not wanted:
        return spark.createDataFrame([], kind)
    units = live_units(op_log, dim)
    zero = F.lit(bytes(4 * dim))
    h = F.xxhash64("ext_id", F.lit(17))
    dealt = written(  # in folders per batch, so that a pass reads its batch only
        units.select("ext_id", "v", h.alias("h"), F.when(F.col("v") == zero, -1).otherwise(F.pmod(h, F.lit(BATCHES))).cast("int").alias("batch")),
        "dealt", "batch",
    )
    records = units.count()
    centres = fit_centres(dealt, dim, centres_for(records))

    def measure(batch):
        x = matrix(batch.column(0), dim)
        label = nearest(x, centres)
        for c in np.unique(label).tolist():
            yield c, _moments(x[label == c], dim, True)

    upper = np.triu_indices(dim)
    moments = {}
    for c, m in _added(dealt.where("batch >= 0").select("v"), measure).items():
        square = np.zeros((dim, dim))
        square[upper] = m[dim + 1 :]
        moments[c] = (m[0], m[1 : dim + 1], square + np.triu(square, 1).T)
    group = joined(moments, len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = matrix(part.column(1), dim)
            label = np.where((x != 0).any(axis=1), group[nearest(x, centres)], -1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(label, pa.int32())], ["ext_id", "h", "cluster"])

    placed = written(dealt.select("ext_id", "v", "h").mapInArrow(run, "ext_id string, h bigint, cluster int"), "placed")
    counts = {r["cluster"]: r["count"] for r in placed.groupBy("cluster").count().collect()}  # at most MOST_CLUSTERS + 1
    rows = [(int(r), c, q, counts[c]) for r, n in wanted for c, q in quotas(counts, n).items() if q]
    quota = spark.createDataFrame(rows, "request_id int, cluster int, quota int, cluster_size bigint")
    most = max((q for _, _, q, _ in rows), default=0)
    # A sample without replacement: the records with the least hash, limited before the shuffle.
    order = Window.partitionBy("cluster").orderBy("h", "ext_id")
    front = placed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return front.join(F.broadcast(quota), "cluster").where("n <= quota").select("request_id", "ext_id", "cluster", "cluster_size")


def per_query(retrieved: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """``(request_id, qid, rank_no, doc_id, place)``: a varied subset of each query's rows.

    Repeated rows count once; a null ``doc_id`` is a document of its own, null texts are alike, and
    null ranks come last.  ``place`` is the order of choice.
    """
    wanted = [(int(r), int(n)) for r, n in sizes if r is not None and n and n > 0]
    most = max((n for _, n in wanted), default=0)
    rows = retrieved.select("qid", "rank_no", "doc_id", "text").distinct()
    last = [F.col(c).asc_nulls_last() for c in ("rank_no", "doc_id", "text")]
    norm = normalised(F.coalesce("text", F.lit("")))
    alike = Window.partitionBy("qid", "norm").orderBy(*last)
    turns = Window.partitionBy("qid", "doc_id").orderBy("copy", last[0], last[2])
    places = Window.partitionBy("qid").orderBy("copy", "turn", *last)
    chosen = (
        rows.withColumn("norm", norm)
        .withColumn("copy", F.least(F.row_number().over(alike), F.lit(2)))
        .withColumn("turn", F.row_number().over(turns))
        .where(F.col("turn") <= most)
        .withColumn("place", F.row_number().over(places))
        .where(F.col("place") <= most)
    )
    asked = F.array(*[F.struct(F.lit(r).alias("request_id"), F.lit(n).alias("n")) for r, n in wanted]) if wanted else F.array(
        F.struct(F.lit(0).alias("request_id"), F.lit(0).alias("n"))
    )
    return chosen.withColumn("a", F.explode(asked)).where(F.col("place") <= F.col("a.n")).select(
        F.col("a.request_id").alias("request_id"), "qid", "rank_no", "doc_id", "place"
    )


def sizes_of(requests: DataFrame, scope: str) -> list[tuple[int, int]]:
    """``(request_id, subset_size)`` of a scope, at most 1000 requests."""
    rows = requests.where(F.col("scope") == scope).select("request_id", "subset_size").orderBy("request_id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1000 requests")
    return [(r[0], r[1]) for r in rows]


def requested(op_log: DataFrame, retrieved: DataFrame, requests: DataFrame, dim: int = DIM) -> DataFrame:
    """All requests: ``(request_id, scope, qid, item, cluster)``.

    ``item`` is the ``ext_id``, or for retrieved rows the ``doc_id``; ``cluster`` is the vector
    cluster's number, or the document.
    """
    live = from_vectors(op_log, sizes_of(requests, "op_log"), dim).select(
        "request_id", F.lit("op_log").alias("scope"), F.lit(None).cast("bigint").alias("qid"),
        F.col("ext_id").alias("item"), F.col("cluster").cast("string").alias("cluster"),
    )
    rows = per_query(retrieved, sizes_of(requests, "retrieved")).select(
        "request_id", F.lit("retrieved").alias("scope"), "qid",
        F.col("doc_id").alias("item"), F.col("doc_id").alias("cluster"),
    )
    return live.unionByName(rows)
