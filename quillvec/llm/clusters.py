"""Similarity clusters by bisecting k-means (problem 3).

All vectors are unit vectors, and similarity is the cosine.  A round divides the records that no
cluster reaches yet, starting with one node.  The nodes above ``LOCAL`` records are split across
the cluster: their tree lives on the driver, the vectors stay where they are, and in a pass every task
sends its rows down the tree and returns count, sum and second moments of each open leaf, which are
added up in a shuffle.  A split starts with a cut through the mean across the principal direction and
is settled by ``SETTLE`` passes of 2-means.  A node of at most ``LOCAL`` records is divided to the end
inside one task, largest dispersion first, each split by 2-means until it stands still.

A leaf is compact when its members' mean cosine to their mean direction reaches ``REACH`` and no
direction of its scatter stands out from that of unrelated vectors.  A compact leaf is a piece of
a cluster if it is closer than any equally large group among so many unrelated records would be by
chance (:func:`chance`).  There is no least share of the records and no limit of leaves; three records
may be a cluster, two are a pair.  Leaves that are no piece of a cluster are divided on down to that.

The means of the pieces are moved to the mean of all records within reach until they stand still,
which joins pieces of one cluster and collects members that were cut off.  Rounds go on until
``TREES`` trees with different cuts find no further cluster.  The first round makes one tree; the
later ones, over the few records left, make all of them in the same passes.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import inf, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.vectors import DIM, binary, matrix, unit_vectors
from quillvec.operators import oplog
from quillvec.session import shuffles_dropped, small, written

REACH = 0.6  # least cosine of a member to its cluster's mean direction
LEAST = 3  # fewer records are no cluster
SURE = log(1e-3)  # log of the expected number of groups by chance below which a group is a cluster
LOCAL = 16_384  # records of a node that one task divides to the end
SEEN = 512  # records of a node whose cosines are looked at together
TREES = 3  # trees that must find nothing before the rounds end
SETTLE = 1  # passes of 2-means after a split of a larger node
SAME = 0.9  # cosine of two means that are one cluster
CELLS = 1 << 22  # cosines to means that a task makes at once


@dataclass
class Tree:
    """Binary trees of centres; node 0 is the first root."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[tuple[int, int] | None] = field(default_factory=list)

    def add(self, centre: np.ndarray) -> int:
        self.centres.append(centre)
        self.children.append(None)
        return len(self.centres) - 1

    def leaves_of(self, x: np.ndarray, root: int = 0) -> np.ndarray:
        """The leaf below ``root`` of each row of ``x``, by one product per level."""
        at = np.full(len(x), root, np.int64)
        centres = np.array(self.centres, np.float32)
        half = (centres * centres).sum(axis=1) / 2
        left = np.array([c[0] if c else -1 for c in self.children])
        right = np.array([c[1] if c else -1 for c in self.children])
        rows = np.flatnonzero(left[at] >= 0)
        while len(rows):
            l, r = left[at[rows]], right[at[rows]]
            nearer = np.einsum("nd,nd->n", x[rows], centres[l] - centres[r]) >= half[l] - half[r]
            at[rows] = np.where(nearer, l, r)
            rows = rows[left[at[rows]] >= 0]
        return at


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x)
    return x / n if n > 0 else x


def chance(total: int, members: int, reach: float, dim: int) -> float:
    """Log of the number of groups of ``members`` whose mean has the length ``reach`` or more, expected
    among ``total`` unrelated unit vectors of ``dim`` dimensions.

    The number of groups times the lesser of two estimates of the probability: by the volume of their
    Gram matrix, which holds for few close members, and by the length of a sum of many.
    """
    if members < 2 or dim < 2:
        return inf
    c = (members * reach * reach - 1) / (members - 1)  # mean cosine between two members
    if c <= 0:
        return inf
    if c >= 1 - 1e-9:
        return -inf
    sums = -dim / 2 * ((members - 1) * c - log(1 + (members - 1) * c))
    volume = (dim - members - 1) / 2 * ((members - 1) * log(1 - c) + log(1 + (members - 1) * c)) if members < dim - 1 else 0.0
    groups = lgamma(total + 1) - lgamma(members + 1) - lgamma(max(0, total - members) + 1)
    return groups + min(sums, volume)


@lru_cache(maxsize=64)
def needed(total: int, dim: int, most: int) -> np.ndarray:
    """Per number of members up to ``most``, the mean cosine between two members that is closer than chance."""
    out = np.full(most + 1, np.inf)
    for m in range(LEAST, most + 1):
        lo, hi = 0.0, 1.0
        for _ in range(30):
            c = (lo + hi) / 2
            if chance(total, m, np.sqrt((1 + (m - 1) * c) / m), dim) < SURE:
                hi = c
            else:
                lo = c
        out[m] = lo
    return out


def closest(x: np.ndarray, total: int) -> np.ndarray | None:
    """Which rows of ``x`` are the group that stands out most from chance; None if no group can.

    In a group some member has at least the group's mean cosine to the others, on average.  Empty
    if one may stand out, but not around that member.
    """
    n, dim = x.shape
    if n < LEAST:
        return None
    cosine = x @ x.T
    np.fill_diagonal(cosine, 2)
    near = np.cumsum(-np.sort(-cosine, axis=1)[:, 1:], axis=1) / np.arange(1, n)  # mean of the nearest m - 1 others
    over = near[:, LEAST - 2 :] - needed(total, dim, SEEN)[LEAST : n + 1]
    if (over < 0).all():
        return None
    row, m = np.unravel_index(int(over.argmax()), over.shape)
    group = np.zeros(n, bool)
    group[np.argsort(-cosine[row], kind="stable")[: m + LEAST]] = True
    return group if _is_cluster(x[group].astype(np.float64), total) else group & False


def _is_cluster(x: np.ndarray, total: int) -> bool:
    """Whether the rows of ``x`` are compact and closer than chance.

    In a group of at most ``SEEN`` every member must be: a pair of near copies and a record that
    happens to lie in their direction are none.
    """
    n, dim = x.shape
    sums = x.sum(axis=0)
    reach = min(1.0, float(np.linalg.norm(sums)) / n)
    if reach < REACH or chance(total, n, reach, dim) >= SURE:
        return False
    return n > SEEN or bool(((x @ sums - 1) / (n - 1) >= needed(total, dim, SEEN)[n] - 1e-6).all())


def _stands_out(n: float, values: np.ndarray, dim: int) -> bool:
    """Whether the scatter has a larger value than unrelated directions reach by chance (Marchenko and Pastur)."""
    return values[-1] > 1.1 * values.sum() / dim * (1 + np.sqrt(dim / n)) ** 2


def _moments(x: np.ndarray, dim: int, second: bool) -> np.ndarray:
    """Count, sum and, if wanted, the upper triangle of the second moments, as one row."""
    x = x.astype(np.float64) if len(x) < 64 else x
    parts = [np.array([len(x)], np.float64), x.sum(axis=0, dtype=np.float64)]
    if second:
        parts.append((x.T @ x)[np.triu_indices(dim)].astype(np.float64))
    return np.concatenate(parts)


def _slices(x: np.ndarray, means: int) -> Iterator[np.ndarray]:
    """``x`` in parts of at most ``CELLS`` cosines to ``means`` means, or of one row."""
    step = max(1, CELLS // max(1, means))
    return (x[i : i + step] for i in range(0, len(x), step))


def _added(rows: DataFrame, run) -> dict[int, np.ndarray]:
    """Runs ``run`` (batches -> {number: moments}) per task and adds up by number.

    A task returns one row per number, whatever its rows; numbers are nodes above ``LOCAL`` records
    or clusters.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in run(batch):
                sums[k] = sums[k] + m if k in sums else m
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())],
                ["k", "m"],
            )

    def per_number(key, part):
        total = sum(np.frombuffer(m, np.float64) for m in part.column("m").to_pylist())
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    partial = rows.mapInArrow(per_task, "k int, m binary")
    return {r["k"]: np.frombuffer(r["m"]) for r in partial.groupBy("k").applyInArrow(per_number, "k int, m binary").collect()}


def _principal(n: float, total: np.ndarray, second: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, values and directions of the scatter of ``n`` rows."""
    mean = total / n
    scatter = second / n - np.outer(mean, mean)
    values, directions = np.linalg.eigh(scatter)
    return mean, np.maximum(values, 0), directions


def divided(x: np.ndarray, total: int, seed: int = 0) -> list[tuple[int, np.ndarray]]:
    """``(members, sum)`` of the compact leaves of ``x`` that are closer than chance among ``total`` records.

    Bisecting 2-means, largest dispersion first, each split until it stands still.  From nodes of at
    most ``SEEN`` records the closest group is split off.  Where no direction stands out, ``seed``
    decides on the first cut.
    """
    dim, rng = x.shape[1], np.random.default_rng(seed)
    found: list[tuple[int, np.ndarray]] = []
    queue: list[tuple[float, int, np.ndarray]] = []
    number = 0

    def push(rows: np.ndarray) -> None:
        nonlocal number
        if len(rows) < LEAST:
            return
        part = x[rows].astype(np.float64)
        sums = part.sum(axis=0)
        reach = float(np.linalg.norm(sums)) / len(rows)
        if _is_cluster(part, total):
            _, values, _ = _principal(len(rows), sums, part.T @ part, dim)
            if values.sum() < 1e-9 or not _stands_out(len(rows), values, dim):
                found.append((len(rows), sums))
                return
        number += 1
        heapq.heappush(queue, (-len(rows) * (1 - reach * reach), number, rows))

    push(np.arange(len(x)))
    while queue:
        _, _, rows = heapq.heappop(queue)
        part = x[rows]
        if len(rows) <= SEEN:
            group = closest(part, total)
            if group is None:
                continue
            if group.any():
                found.append((int(group.sum()), part[group].sum(axis=0, dtype=np.float64)))
                push(rows[~group])
                continue
        centred = (part - part.mean(axis=0)).astype(np.float64)
        values, directions = np.linalg.eigh(centred.T @ centred / len(rows))
        out = _stands_out(len(rows), values, dim)
        side = centred @ (directions[:, -1] if out else rng.normal(size=dim)) > 0
        cut = side
        m, sums = int(side.sum()), side @ centred  # the other side's sum is the negative
        while 0 < m < len(side):
            # The sides' means are sums / m and -sums / (n - m), so that they differ in the direction of sums.
            new = centred @ sums > sums @ sums * (1 / m - 1 / (len(side) - m)) / 2
            n, moved = int(new.sum()), new @ centred
            if (new == side).all() or not 0 < n < len(new):
                break
            gain = lambda k, s: float(s @ s) * (1 / k + 1 / (len(side) - k))
            if gain(n, moved) <= gain(m, sums) * (1 + 1e-9):
                break
            side, m, sums = new, n, moved
        if not 0 < side.sum() < len(side):
            side = cut
        if not 0 < side.sum() < len(side):
            side = np.arange(len(rows)) < len(rows) // 2 if values.sum() > 1e-12 else side
        if not 0 < side.sum() < len(side):  # all rows are alike
            continue
        push(rows[side])
        push(rows[~side])
    return found


def _bisect(left: DataFrame, dim: int, total: int, seeds: range) -> list[tuple[np.ndarray, int]]:
    """Mean directions of the pieces of clusters among the ``total`` records of ``left``, and the tree of each.

    There is one tree per seed; all are made in the same passes.
    """
    tree, rngs = Tree(), [np.random.default_rng(seed) for seed in seeds]
    roots = [tree.add(np.zeros(dim)) for _ in seeds]
    own = {root: t for t, root in enumerate(roots)}  # the tree of a node
    pieces: list[tuple[float, np.ndarray, int]] = []
    local: set[int] = set(roots) if total <= LOCAL else set()
    active = set() if local else set(roots)
    whole: dict[int, float] = {}  # rows of a node's parent
    settle = 0
    while active:
        wanted, second = frozenset(active), settle == 0

        def run(batch, tree=tree, wanted=wanted, second=second, open_roots=sorted({roots[own[k]] for k in active})):
            x = matrix(batch.column(0), dim)
            for root in open_roots:
                leaf = tree.leaves_of(x, root)
                for k in np.unique(leaf).tolist():
                    if k in wanted:
                        yield k, _moments(x[leaf == k], dim, second)

        sums = _added(left, run)
        if settle:
            settle -= 1
            for k in active:
                n = sums[k][0] if k in sums else 0
                if 0 < n < whole[k]:  # else the cut stays as it is
                    tree.centres[k] = sums[k][1 : dim + 1] / n
            continue
        splits = []
        for k in sorted(active):
            n = sums[k][0] if k in sums else 0
            if n < LEAST:
                continue
            square = np.zeros((dim, dim))
            square[np.triu_indices(dim)] = sums[k][dim + 1 :]
            square = np.triu(square) + np.triu(square, 1).T
            mean, values, directions = _principal(n, sums[k][1 : dim + 1], square, dim)
            reach = float(np.linalg.norm(mean))
            if reach >= REACH and chance(total, int(n), min(1.0, reach), dim) < SURE and (
                values.sum() < 1e-9 or not _stands_out(n, values, dim)
            ):
                pieces.append((n, unit(mean), own[k]))
            elif n <= LOCAL:
                local.add(k)
            elif values.sum() > 1e-12:
                away = directions[:, -1] if _stands_out(n, values, dim) else unit(rngs[own[k]].normal(size=dim))
                splits.append((k, n, mean, away * np.sqrt(values[-1])))
        active = set()
        for k, n, mean, direction in splits:
            pair = tree.add(mean + direction), tree.add(mean - direction)
            tree.children[k] = pair
            active |= set(pair)
            whole |= {pair[0]: n, pair[1]: n}
            own |= {pair[0]: own[k], pair[1]: own[k]}
        settle = SETTLE

    if local:
        nodes = frozenset(local)

        def sent(batches: Iterator[pa.RecordBatch], tree=tree, open_roots=sorted({roots[own[k]] for k in local})) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for root in open_roots:
                    leaf = tree.leaves_of(matrix(batch.column(0), dim), root)
                    made = pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), batch.column(0)], ["k", "v"])
                    yield made.filter(pa.array(np.isin(leaf, list(nodes))))

        def subtree(key, part):
            k = key[0].as_py()
            blocks = [matrix(b, dim) for b in part.column("v").chunks]
            x = np.concatenate(blocks) if blocks else np.zeros((0, dim), np.float32)
            x = x[np.lexsort(x.T)]  # the same tree in whatever order the rows come
            made = divided(x, total, seeds[own[k]])
            return pa.table({"k": pa.array([k] * len(made), pa.int32()), "n": pa.array([n for n, _ in made], pa.int64()),
                             "s": binary(np.array([s for _, s in made], np.float32).reshape(-1, dim))})

        grouped = left.mapInArrow(sent, "k int, v binary").groupBy("k").applyInArrow(subtree, "k int, n bigint, s binary")
        pieces += [(r["n"], unit(np.frombuffer(r["s"], np.float32).astype(np.float64)), own[r["k"]]) for r in grouped.collect()]
    return [(m, t) for _, m, t in sorted(pieces, key=lambda p: (-p[0], p[1].tobytes(), p[2]))]


def _distinct(means: list[np.ndarray]) -> list[int]:
    """The numbers of the means that no earlier one is the same as."""
    kept: list[int] = []
    for k, m in enumerate(means):
        if not kept or (np.array([means[o] for o in kept]) @ m).max() <= SAME:
            kept.append(k)
    return kept


def _shifted(vectors: DataFrame, dim: int, means: list[np.ndarray], total: int) -> list[np.ndarray]:
    """Moves means to the mean of the records in reach until they stand still.

    Joins means of one cluster, and drops those whose records are no closer than chance.  A mean that
    stands still is not compared again.
    """
    moving = [True] * len(means)
    while any(moving):
        m = np.array([o for o, moves in zip(means, moving) if moves], np.float32)

        def run(batch, m=m):
            for x in _slices(matrix(batch.column(0), dim), len(m)):
                k, row = np.divmod(np.flatnonzero(m @ x.T >= REACH), len(x))  # by number
                ends = np.flatnonzero(np.diff(k, append=-1)) + 1
                for a, b in zip([0, *ends[:-1]], ends):
                    yield int(k[a]), _moments(x[row[a:b]], dim, False)

        sums = _added(vectors, run)
        moved, at = [], -1
        for mean, moves in zip(means, moving):
            if not moves:
                moved.append((mean, False))
                continue
            at += 1
            n = sums[at][0] if at in sums else 0
            reach = min(1.0, float(np.linalg.norm(sums[at][1:])) / n) if n else 0.0
            if n >= LEAST and chance(total, int(n), reach, dim) < SURE:
                new = unit(sums[at][1:])
                moved.append((new, 1 - float(new @ mean) >= 1e-6))
        kept = _distinct([mean for mean, _ in moved])
        means, moving = [moved[i][0] for i in kept], [moved[i][1] for i in kept]
    return means


def found_clusters(vectors: DataFrame, dim: int = DIM) -> tuple[np.ndarray, list[int]]:
    """Mean directions of the clusters of ``(v binary)``, largest piece first, and their leaves."""
    means: list[np.ndarray] = []
    leaves: list[int] = []
    left, seeds = vectors.select("v").where(F.col("v") != F.lit(bytes(4 * dim))), range(1)
    total = left.count()
    while seeds:
        with shuffles_dropped(vectors.sparkSession):
            found = _bisect(left, dim, total, seeds) if total >= LEAST else []
        before = len(means)
        # Joined before they are moved, so that a cluster of many leaves is moved once.  Records of
        # the earlier clusters are out of the reach of these.
        means += _shifted(left, dim, [found[k][0] for k in _distinct([m for m, _ in found])], total)
        if len(means) == before:
            seeds = range(seeds.stop, TREES)  # the trees that have not been tried on these records
            continue
        own = [Counter() for _ in means]
        for (_, t), k in zip(found, np.argmax(np.array([m for m, _ in found]) @ np.array(means).T, axis=1).tolist()):
            own[k][t] += 1
        leaves += [0] * (len(means) - before)
        for k, n in enumerate(own):
            leaves[k] += n[min(n)] if n else 0  # of the first tree that has any
        m = np.array(means[before:], np.float32)

        def rest(batches: Iterator[pa.RecordBatch], m=m) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = [(x @ m.T).max(axis=1) < REACH for x in _slices(matrix(batch.column(0), dim), len(m))]
                yield batch.filter(pa.array(np.concatenate(far))) if far else batch

        left, seeds = written(left.mapInArrow(rest, "v binary"), "left"), range(TREES)
        total = left.count()
    return np.array(means, np.float32).reshape(-1, dim), leaves


def cluster_means(vectors: DataFrame, dim: int = DIM) -> np.ndarray:
    """Mean directions of the clusters of ``(v binary)``."""
    return found_clusters(vectors, dim)[0]


def assigned(vectors: DataFrame, means: np.ndarray, dim: int = DIM) -> DataFrame:
    """``vectors`` without ``v``, with ``cluster int`` and ``cosine``.

    A record goes to its nearest mean if that is within ``REACH``; else, and if it is all zero, its
    cluster is null.
    """
    keys = [f for f in vectors.schema.fields if f.name != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(len(keys)), dim)
            best, cosine = np.zeros(len(x), np.int64), np.full(len(x), -1.0)
            at = 0
            for part in _slices(x, len(means)) if len(means) else ():
                score = part @ means.T
                to, at = at, at + len(part)
                best[to:at] = score.argmax(axis=1)
                cosine[to:at] = score[np.arange(len(part)), best[to:at]]
            far = cosine < REACH
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(best, pa.int32(), mask=far), pa.array(cosine, mask=far)],
                [*(f.name for f in keys), "cluster", "cosine"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return vectors.select(*(f.name for f in keys), "v").mapInArrow(run, f"{kinds}, cluster int, cosine double")


def _with_anchors(op_log: DataFrame, anchors: DataFrame, dim: int) -> DataFrame:
    state = oplog.fold(op_log.select("lsn", "op", "ext_id", "vec"), dim, with_meta=False)
    live = unit_vectors(state, "ext_id", "vec", dim)
    own = unit_vectors(anchors.where(F.col("anchor_id").isNotNull()), "anchor_id", "vec", dim)
    rows = live.select(F.lit(None).cast("int").alias("anchor_id"), "ext_id", "v").unionByName(
        own.select(F.col("anchor_id").cast("int"), F.lit(None).cast("string").alias("ext_id"), "v")
    )
    with shuffles_dropped(op_log.sparkSession):
        return written(rows, "clustered")


def anchored(op_log: DataFrame, anchors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(anchor_id, ext_id)``: live records and anchors that are in one cluster.

    Anchors with a null, short or non-finite vector are in none, as are all-zero vectors.
    """
    rows = _with_anchors(op_log, anchors, dim)
    means = cluster_means(rows, dim)
    # Filtered before they are compared, which the scan does.
    own, live = (assigned(rows.where(F.col(k).isNotNull()).select(k, "v"), means, dim).where(F.col("cluster").isNotNull()) for k in ("anchor_id", "ext_id"))
    own = own.select("anchor_id", "cluster").distinct()
    return live.select("ext_id", "cluster").join(small(own, 10_000), "cluster").select("anchor_id", "ext_id")


def described(op_log: DataFrame, anchors: DataFrame, dim: int = DIM, typical: int = 5) -> DataFrame:
    """``(cluster, leaves, size, least_cosine, mean_cosine, typical)`` of each cluster of live records.

    ``leaves`` counts the leaves of the tree that make up the cluster, ``typical`` lists the ``ext_id``s nearest to the mean direction, nearest first (ties by id).
    Records in no cluster are the row with null cluster, leaves, cosines and members.
    """
    rows = _with_anchors(op_log, anchors, dim)
    means, leaves = found_clusters(rows, dim)
    placed = written(assigned(rows, means, dim).where(F.col("ext_id").isNotNull()), "placed")
    sizes = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.min("cosine").alias("least_cosine"), F.avg("cosine").alias("mean_cosine")
    )
    nearest = Window.partitionBy("cluster").orderBy(F.col("cosine").desc(), "ext_id")
    top = (
        placed.where(F.col("cluster").isNotNull()).withColumn("n", F.row_number().over(nearest))
        .where(F.col("n") <= typical).groupBy("cluster")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "ext_id"))), lambda x: x["ext_id"]).alias("typical"))
    )
    own = op_log.sparkSession.createDataFrame([(k, n) for k, n in enumerate(leaves)], "cluster int, leaves int")  # a row per cluster
    return sizes.join(top, "cluster", "left").join(own, "cluster", "left").select(
        "cluster", "leaves", "size", "least_cosine", "mean_cosine", "typical"
    )


def memberships(op_log: DataFrame, anchors: DataFrame, dim: int = DIM) -> DataFrame:
    """``(ext_id, cluster, cosine)`` of every live record; a null cluster means apart from all."""
    rows = _with_anchors(op_log, anchors, dim)
    return assigned(rows, cluster_means(rows, dim), dim).where(F.col("ext_id").isNotNull()).drop("anchor_id")
