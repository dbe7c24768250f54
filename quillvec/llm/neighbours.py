"""Most similar vectors for every vector, by additive quantisation (problem 5).

A unit vector is written as a sum of full-dimensional codewords, one of each codebook.  Codebooks
are fitted on a bounded sample: residual k-means level by level, then a joint least-squares update
for the codes found.  Encoding is a beam search that keeps the best partial sums over the codebooks.
The stored norm of the sum turns inner products with it into cosines.

The first two codebooks also make the inverted lists: a list for each pair of their codewords.  A
query's look-up tables (its products with the codewords) and the stored products of the codewords
give its distance to all lists, and it visits the nearest ``probes`` of them.  In a list, candidates
are scored from their codes and the best of them from their vectors; the best of all lists are
merged and reranked by exact cosines.  Vectors travel to the lists as one byte per dimension, which
is precise enough to choose what is reranked.
Scores by tables are sums of table entries over a candidate's codes; as the product with the summed
codewords is the same number and much faster for blocks of queries, blocks are scored that way.

Every record is in one list and is looked for in all of its lists: nothing is dropped or sampled.
The lists are searched in several passes if the visits are many, so that the rows under way at one time,
and the disk they take, follow the records and not the visits.
A list with many records is cut into blocks, and every query of the list meets all its blocks.
Records with equal vectors are indexed once, and put back in full after the search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm.vectors import DIM, live_units, matrix
from quillvec.session import shuffles_dropped, small, written

SAMPLE = 32_768  # rows that the codebooks are fitted on, at most
LIST_RECORDS = 512  # records a list is to hold on average
BOOKS, FINE = 8, 64  # codebooks: two for the lists, the others with FINE codewords, at most 256
BEAM = 2
PROBES = 6  # lists a record visits if there are PROBES_OF of them; with more lists it visits more
PROBES_OF = 64
ROUNDING = 0.03  # what a cosine may lose by one byte per dimension
SPARE = 8  # neighbours beyond k that are reranked
BLOCK_RECORDS, BLOCK_QUERIES = 16_384, 32_768
# Settings for neighbours at any distance: in many dimensions those lie in many lists.
THOROUGH = {"lists": 64, "probes": 16, "books": 8, "fine": 256}
SLACK = 4.0  # standard deviations of the codes' error allowed for near neighbours
PASS_VISITS, LEAST_VISITS = 4, 1 << 20  # visits of a pass: so many per record, or in all if that is more
MAX_LISTS = 65_536  # beyond this many, lists grow and are searched in blocks
RERANK = 20  # candidates of a list compared exactly, as a multiple of k


@dataclass
class Codebooks:
    """Codebooks and what is stored of them."""

    books: list[np.ndarray]  # each (codewords, dim)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """``(rows, books)`` codes by beam search; ties go to the lower code."""
        n = len(x)
        sums = np.zeros((n, 1, x.shape[1]), np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        cost = np.zeros((n, 1), np.float32)
        for book in self.books:
            width = codes.shape[1]
            norms = (book * book).sum(axis=1)
            # |x - s - c|^2 = |x - s|^2 - 2 (x - s) c + |c|^2
            rest = (x[:, None, :] - sums).reshape(n * width, -1)
            new = cost[:, :, None] + (norms[None, :] - 2 * (rest @ book.T)).reshape(n, width, -1)
            flat = new.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            rows = np.arange(n)[:, None]
            order = np.argsort(flat[rows, best], axis=1, kind="stable")
            best = best[rows, order]
            at, word = best // len(book), best % len(book)
            sums = sums[rows, at] + book[word]
            codes = np.concatenate([codes[rows, at], word[:, :, None].astype(np.uint8)], axis=2)
            cost = flat[rows, best]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of the codewords."""
        return sum(book[codes[:, m]] for m, book in enumerate(self.books))

    def nearest_lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """``(rows, probes)`` list numbers, from the tables of the first two codebooks."""
        a, b = self.books[0], self.books[1]
        stored = ((a[:, None, :] + b[None, :, :]) ** 2).sum(axis=2)
        tables = (x @ a.T)[:, :, None] + (x @ b.T)[:, None, :]
        cost = (stored[None] - 2 * tables).reshape(len(x), -1)
        probes = min(probes, cost.shape[1])
        return np.argpartition(cost, probes - 1, axis=1)[:, :probes] if probes < cost.shape[1] else np.tile(np.arange(probes), (len(x), 1))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        label = ((centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)).argmin(axis=1)
        count = np.bincount(label, minlength=len(centres))
        order = np.argsort(label, kind="stable")
        filled = np.flatnonzero(count)
        sums = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(count[filled])[:-1])), axis=0)
        centres[filled] = sums / count[filled][:, None]
    return centres


def fit_codebooks(x: np.ndarray, lists: int, number: int = BOOKS, fine: int = FINE, seed: int = 5) -> Codebooks:
    """``number`` codebooks from sample rows ``x``, the first two for about ``lists`` lists."""
    rng = np.random.default_rng(seed)
    side = max(1, int(round(np.sqrt(lists))))
    books, rest = [], x.astype(np.float32)
    for m in range(number):
        book = _kmeans(rest, side if m < 2 else fine, rng)
        label = ((book * book).sum(axis=1)[None] - 2 * (rest @ book.T)).argmin(axis=1)
        rest = rest - book[label]
        books.append(book)
    made = Codebooks(books)
    # Joint update: least squares for all codewords, given the codes of the beam search.
    sizes = [len(b) for b in books]
    codes = made.encode(x).astype(np.int64) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    gram, right = np.zeros((sum(sizes), sum(sizes))), np.zeros((sum(sizes), x.shape[1]))
    for m in range(number):
        np.add.at(right, codes[:, m], x)
        for o in range(number):
            np.add.at(gram, (codes[:, m], codes[:, o]), 1.0)
    solved = np.linalg.lstsq(gram + 1e-3 * np.eye(len(gram)), right, rcond=None)[0].astype(np.float32)
    return Codebooks(np.split(solved, np.cumsum(sizes)[:-1]))


def _merge(best: np.ndarray, who: np.ndarray, score: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k per row of ``(best, who)`` and new ``(score, at)``."""
    score, at = np.concatenate([best, score], 1), np.concatenate([who, at], 1)
    if score.shape[1] <= k:
        return score, at
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rows = np.arange(len(score))[:, None]
    return score[rows, top], at[rows, top]


def search_block(
    queries: np.ndarray, exact: np.ndarray, decoded: np.ndarray, k: int, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, cosine)`` of the best k candidates of each query with cosine >= least.

    ``decoded`` are the candidates as their codes tell, scaled by the stored norms; what scores
    best by them is compared with ``exact``.
    """
    wide = max(32, RERANK * k)
    if least > -1:
        # A query at cosine c of a record scores c * o by its codes, o being the record's own score,
        # give or take a part of what lies off both; SLACK standard deviations of that are allowed.
        own_score = np.clip((decoded * exact).sum(axis=1), -1, 1)
        off = np.sqrt((1 - least * least) * (1 - own_score * own_score) / exact.shape[1])
        limit = np.minimum(least * own_score - SLACK * off, least).astype(np.float32)
    out = []
    for q0 in range(0, len(queries), 512):
        q = queries[q0 : q0 + 512]
        if least > -1:
            parts = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for c0 in range(0, len(exact), 8192):
                score = q @ decoded[c0 : c0 + 8192].T
                i, j = np.nonzero(score >= limit[c0 : c0 + 8192])
                parts.append((i, j + c0))
            i, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            cosine = np.empty(len(i), np.float32)
            for s in range(0, len(i), 1 << 16):
                cosine[s : s + (1 << 16)] = np.einsum("nd,nd->n", q[i[s : s + (1 << 16)]], exact[j[s : s + (1 << 16)]])
            keep = cosine >= least
            i, j, cosine = i[keep], j[keep], cosine[keep]
            order = np.lexsort((j, -cosine, i))
            i, j, cosine = i[order], j[order], cosine[order]
            first = np.searchsorted(i, i, side="left")
            keep = np.arange(len(i)) - first < k
            out.append((i[keep] + q0, j[keep], cosine[keep]))
            continue
        best = np.empty((len(q), 0), np.float32)
        who = np.empty((len(q), 0), np.int64)
        for c0 in range(0, len(exact), 4096):
            score = q @ decoded[c0 : c0 + 4096].T
            n = min(wide, score.shape[1])
            at = np.argpartition(-score, n - 1, axis=1)[:, :n] if n < score.shape[1] else np.tile(np.arange(n), (len(q), 1))
            best, who = _merge(best, who, np.take_along_axis(score, at, 1), at + c0, wide)
        cosine = np.einsum("qd,qnd->qn", q, exact[who]) if who.size else best
        n = min(k, cosine.shape[1])
        order = np.lexsort((who, -cosine), axis=1)[:, :n]
        out.append(
            (
                np.repeat(np.arange(len(q)) + q0, n),
                np.take_along_axis(who, order, 1).ravel(),
                np.take_along_axis(cosine, order, 1).ravel(),
            )
        )
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*out))


def _sample(vectors: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """At most ``SAMPLE`` rows, those with the least hash of their id, and the number of rows."""
    total = vectors.count()
    share = min(1.0, 1.3 * SAMPLE / max(1, total))
    limit = int(share * (2**31 - 1))
    hashed = F.xxhash64("ext_id").bitwiseAND(F.lit(2**31 - 1))
    rows = vectors.where(hashed <= limit).orderBy(hashed, "ext_id").limit(SAMPLE).select("v").toArrow()
    parts = [matrix(b.column(0), dim) for b in rows.combine_chunks().to_batches()]
    return (np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)), total


def probes_among(lists: int, probes: int = PROBES) -> int:
    """Lists to visit of ``lists``, so that about as few pairs are missed as with ``probes`` of ``PROBES_OF``."""
    return max(probes, int(np.ceil(probes * (lists / PROBES_OF) ** (1 / 3) - 1e-9)))


def passes_for(visits: int, records: int) -> int:
    """Passes over the lists, each with a part of the visits."""
    return max(1, -(-visits // max(PASS_VISITS * records, LEAST_VISITS)))


def _search(
    vectors: DataFrame, queries: Column | None, k: int, least: float, lists: int | None, probes: int,
    number: int, fine: int, dim: int,
) -> DataFrame:
    """``(ext_id, other, cosine)``: best k others of each query among records with unlike vectors."""
    sample, total = _sample(vectors, dim)
    kind = "ext_id string, other string, cosine double"
    if total == 0:
        return vectors.sparkSession.createDataFrame([], kind)
    if lists is None:
        lists = min(MAX_LISTS, max(1, total // LIST_RECORDS))
        probes = probes_among(lists, probes)
    books = fit_codebooks(sample, lists, number, fine)
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # size depends on the number of lists only

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            step = max(64, min(2048, (1 << 21) // (len(books.books[0]) * len(books.books[1]))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(1), dim)
                codes = books.encode(x)
                home = codes[:, 0].astype(np.int32) * len(books.books[1]) + codes[:, 1]
                near = books.nearest_lists(x, probes).astype(np.int32)
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1])
                norm = np.linalg.norm(books.decode(codes), axis=1).astype(np.float32)
                packed = pa.Array.from_buffers(
                    pa.binary(), len(x),
                    [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * number), pa.py_buffer(np.ascontiguousarray(codes))],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), packed, pa.array(norm), pa.array(home),
                     pa.ListArray.from_arrays(offsets, pa.array(near.ravel())), rounded(x)],
                    ["ext_id", "asks", "codes", "norm", "home", "near", "q8"],
                )

    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    indexed = written(
        vectors.select("ext_id", "v", asks.alias("asks")).mapInArrow(
            index, "ext_id string, asks boolean, codes binary, norm float, home int, near array<int>, q8 binary"
        ),
        "indexed",
    )
    visits = indexed.where("asks").select("ext_id", "q8", "home", F.explode("near").alias("list"))
    # Lists that need more than one block; there are at most as many as full blocks.
    record_blocks = indexed.groupBy(F.col("home").alias("list")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_RECORDS).cast("int").alias("rb")
    )
    query_blocks = visits.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qb"))
    blocks = small(written(record_blocks.join(query_blocks, "list").where("rb > 1 or qb > 1"), "blocks"))
    spread = F.xxhash64("ext_id").bitwiseAND(F.lit(2**31 - 1))
    one = F.lit(1)
    rb, qb = F.coalesce("rb", one), F.coalesce("qb", one)
    whole = F.col("rb").isNull()  # in a list of one block a record asks where it is
    asking = total if queries is None else indexed.where("asks").count()
    passes = passes_for(asking * min(probes, len(books.books[0]) * len(books.books[1])), total)

    def under_way(turn: int) -> DataFrame:
        """Records and queries of the lists of one pass."""
        ours = F.pmod(F.hash("list"), F.lit(passes)) == turn
        records = (
            indexed.select("ext_id", "q8", "codes", "norm", "asks", F.col("home").alias("list"), F.array_contains("near", F.col("home")).alias("_own"))
            .where(ours).join(blocks, "list", "left")
            .select("list", (spread % rb).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), qb - 1)).alias("q"),
                    (F.col("asks") & whole & F.col("_own")).alias("asks"), "ext_id", "q8", "codes", "norm")
        )
        asked = (
            visits.where(ours).join(blocks, "list", "left").where(~whole | (F.col("list") != F.col("home")))
            .select("list", F.explode(F.sequence(F.lit(0), rb - 1)).alias("r"), (spread % qb).cast("int").alias("q"),
                    F.lit(True).alias("asks"), "ext_id", "q8",
                    F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"))
        )
        return records.unionByName(asked)

    near_only = least > -1

    def search(part):
        books = shared.value
        part = part.combine_chunks()
        is_record = part.column("codes").is_valid()
        theirs = part.filter(is_record).sort_by("ext_id")
        homed, guests = theirs.filter(theirs.column("asks")), part.filter(pa.compute.invert(is_record))
        none = pa.table({"ext_id": pa.array([], pa.string()), "other": pa.array([], pa.string()), "cosine": pa.array([], pa.float64())})
        if len(theirs) == 0 or len(homed) + len(guests) == 0:
            return none
        column = lambda t, c: t.column(c).combine_chunks()
        flat = lambda t, c: t.chunk(0) if isinstance(t := column(t, c), pa.ChunkedArray) else t
        exact = unrounded(flat(theirs, "q8"), dim)
        q = np.concatenate([exact[theirs.column("asks").to_numpy()], unrounded(flat(guests, "q8"), dim)])
        ids = pa.concat_arrays([flat(homed, "ext_id"), flat(guests, "ext_id")] if len(homed) and len(guests)
                               else [flat(homed if len(homed) else guests, "ext_id")])
        others = flat(theirs, "ext_id")
        codes = np.frombuffer(b"".join(theirs.column("codes").to_pylist()), np.uint8).reshape(-1, number)
        norm = theirs.column("norm").to_numpy()
        decoded = books.decode(codes) / np.maximum(norm, 1e-9)[:, None]
        i, j, cosine = search_block(q, exact, decoded, k + SPARE, least - ROUNDING if near_only else least)
        made = pa.table({"ext_id": ids.take(pa.array(i)), "other": others.take(pa.array(j)), "cosine": pa.array(cosine.astype(np.float64))})
        return made.filter(pa.compute.not_equal(made.column("ext_id"), made.column("other")))

    turns = [under_way(turn).groupBy("list", "r", "q").applyInArrow(search, kind) for turn in range(passes)]
    if near_only or passes > 1:
        with shuffles_dropped(vectors.sparkSession):
            turns = [written(t, "met") for t in turns]
    found = reduce(DataFrame.unionByName, turns)
    if near_only and queries is None:
        # A pair that one side has found is one for both.
        back = found.select(F.col("other").alias("ext_id"), F.col("ext_id").alias("other"), "cosine")
        found = found.unionByName(back).groupBy("ext_id", "other").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("ext_id").orderBy(F.col("cosine").desc(), "other")
    pairs = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + SPARE)
    return _reranked(pairs.select("ext_id", "other"), vectors, least, dim).withColumn("_n", F.row_number().over(best)).where(
        F.col("_n") <= k
    ).drop("_n")


def rounded(x: np.ndarray) -> pa.Array:
    """Unit vectors as one byte per dimension."""
    top = np.abs(x).max(axis=1, keepdims=True)
    small_ = np.rint(np.divide(127 * x, top, out=np.zeros_like(x), where=top > 0)).astype(np.int8)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(small_))])


def unrounded(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors from one byte per dimension."""
    if len(column) == 0:
        return np.zeros((0, dim), np.float32)
    x = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _reranked(pairs: DataFrame, vectors: DataFrame, least: float, dim: int) -> DataFrame:
    """``(ext_id, other, cosine)`` with exact cosines, of the pairs that reach ``least``."""
    pairs = written(pairs, "pairs")
    full = pairs.join(vectors.select("ext_id", F.col("v").alias("_a")), "ext_id").join(
        vectors.select(F.col("ext_id").alias("other"), F.col("v").alias("_b")), "other"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (matrix(batch.column(i), dim).astype(np.float64) for i in (2, 3))
            cosine = pa.array((a * b).sum(axis=1))
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cosine], ["ext_id", "other", "cosine"])
            yield made.filter(pa.compute.greater_equal(cosine, least))

    return full.select("ext_id", "other", "_a", "_b").mapInArrow(run, "ext_id string, other string, cosine double")


def most_similar(
    vectors: DataFrame,
    k: int = 10,
    least: float = -1.0,
    queries: Column | None = None,
    lists: int | None = None,
    probes: int = PROBES,
    books: int = BOOKS,
    fine: int = FINE,
    dim: int = DIM,
) -> DataFrame:
    """``(ext_id, rank_no, other, cosine)``: the k most similar other records of each query.

    ``vectors`` is ``(ext_id, v)`` of unit vectors with distinct ids, as a written table.  All-zero
    vectors have no direction: they are neither queries nor neighbours.  Only neighbours with a
    cosine of ``least`` or more are looked for.  ``queries`` is a condition on ``ext_id`` (all
    records if None).  Equal cosines rank by ``ext_id``, bytewise.  Fewer than k rows come out where
    there are fewer such records.
    """
    zero = F.lit(bytes(4 * dim))
    vectors = vectors.where(F.col("v") != zero)
    # Equal vectors: one of them stands for all.
    digest = F.xxhash64("v")
    twice = written(vectors.groupBy(digest.alias("_h")).count().where("count > 1").select("_h"), "twice")
    maybe = written(vectors.withColumn("_h", digest).join(twice, "_h", "left_semi").select("v", "ext_id"), "maybe")
    heads = maybe.groupBy("v").agg(F.min("ext_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = maybe
    of = written(copies.join(heads, "v").select("head", "ext_id"), "heads")
    spare = of.where("head <> ext_id").select("ext_id")
    single = vectors.join(spare, "ext_id", "left_anti")
    asks = queries
    if queries is not None:  # a head asks if any of its copies does
        asking = of.where(queries).select(F.col("head").alias("_head")).distinct()
        single = single.join(asking, single["ext_id"] == F.col("_head"), "left")
        asks = queries | F.col("_head").isNotNull()
    found = written(_search(single, asks, k, least, lists, probes, books, fine, dim), "found")

    # Put the copies back: k + 1 of each group are enough as neighbours, all of them ask.
    first = Window.partitionBy("head").orderBy("ext_id")
    shown = of.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    near = found.join(shown.select(F.col("head").alias("other"), F.col("ext_id").alias("_copy")), "other", "left")
    near = near.select("ext_id", F.coalesce("_copy", "other").alias("other"), "cosine")
    own = shown.select(F.col("head").alias("ext_id"), F.col("ext_id").alias("other"), F.lit(1.0).alias("cosine"))
    best = Window.partitionBy("ext_id").orderBy(F.col("cosine").desc(), "other")
    merged = near.unionByName(own).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1).drop("_n")
    asked = merged.join(of.select(F.col("head").alias("ext_id"), F.col("ext_id").alias("_copy")), "ext_id", "left")
    asked = asked.select(F.coalesce("_copy", "ext_id").alias("ext_id"), "other", "cosine").where("ext_id <> other")
    if queries is not None:
        asked = asked.where(queries)
    return asked.withColumn("rank_no", F.row_number().over(best)).where(F.col("rank_no") <= k).select(
        "ext_id", "rank_no", "other", "cosine"
    )


def mutual_pairs(op_log: DataFrame, k: int = 10, least: float = 0.96, dim: int = DIM) -> DataFrame:
    """``(ext_a, ext_b)``: live records with cosine >= ``least``, each among the other's k nearest.

    All records within ``least`` of a record rank before those beyond, so the k nearest within it
    decide.  Cosines are compared as float32 with a tolerance of one part in a million.
    """
    with shuffles_dropped(op_log.sparkSession):
        near = written(most_similar(live_units(op_log, dim), k, least - 1e-6, dim=dim).select("ext_id", "other"), "near")
    back = near.select(F.col("ext_id").alias("other"), F.col("other").alias("ext_id"))
    return near.join(back, ["ext_id", "other"]).where("ext_id < other").select(
        F.col("ext_id").alias("ext_a"), F.col("other").alias("ext_b")
    )
