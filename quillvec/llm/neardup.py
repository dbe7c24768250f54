"""Near copies with small edits (problem 4).

Two texts are near copies if the sets of their 8-character substrings, after normalisation, have a
Jaccard similarity of at least 0.5.

Candidates come from covering locality-sensitive hashing.  A text becomes a word of minhash symbols,
``GROUPS`` groups of 7.  Each group is hashed under 7 bit masks, the lines of the Fano plane: a mask
keeps 3 of the 7 positions.  The masks cover: wherever the symbols of two texts differ in at most 2
positions of a group, some mask keeps only equal positions, so the pair is certain to meet in that
mask's table.  (With more differences it still meets if the equal positions hold a line.)  At a
similarity of exactly 0.5 a group misses half the pairs, so 7 groups find 99.2 %, at 0.6 99.98 %.

A table row also carries four bit planes of 64 symbols.  Pairs that meet are first compared by
these 256 bits inside the join; at a similarity of 0.5 the test passes 99.9 % of the pairs.
What is left is compared exactly, on the full texts.

Exact copies are one class from the start and are looked at once, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillvec.session import written

SHINGLE = 8  # characters
THRESHOLD = 0.5
MIN_CHARS = 200  # shorter normalised texts are no case
GROUPS = 7
SYMBOLS = 64  # of which 7 * GROUPS are hashed; all go into the bit planes
BITS = (2, 6, 10, 14)  # of a symbol: the least of n hashes has some 32 - log2(n) random bits, the lower ones
# Expected differences at the threshold are 30 of 64, with a standard deviation of 4.
MAX_DIFFERENCES = 43
LINES = ((0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5))

_STEP = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 8192  # shingles hashed at once


def normalised(text: Column) -> Column:
    """A-Z to a-z, runs of space, \\t \\n \\v \\f \\r to one space, trimmed."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, "[ \\t\\n\\x0B\\f\\r]+", " "))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return (
        (rng.integers(1, 2**32, SYMBOLS, dtype=np.uint32) | np.uint32(1))[:, None],
        rng.integers(0, 2**32, SYMBOLS, dtype=np.uint32)[:, None],
    )


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the 8-character substrings of ``text``, in order; empty if it is shorter."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(chars) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = chars[:n].copy()
    for j in range(1, SHINGLE):
        h *= _STEP
        h += chars[j : j + n]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def signature(text: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minhash symbols of a text of at least 8 characters."""
    h = (shingle_hashes(text) >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(h), _BLOCK):
        m = h[None, at : at + _BLOCK] * a
        m += b
        low = m.min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def mask_keys(symbols: np.ndarray, kind: int) -> np.ndarray:
    """``(rows, 7 * GROUPS)`` table keys: table number and the symbols its mask keeps, hashed."""
    s = symbols.astype(np.uint64)
    out = np.empty((len(s), 7 * GROUPS), np.uint64)
    for g in range(GROUPS):
        for m, line in enumerate(LINES):
            x = np.full(len(s), (kind * GROUPS + g) * 7 + m + 1, np.uint64)
            for p in line:
                x = (x ^ s[:, 7 * g + p]) * _MIX
                x ^= x >> np.uint64(29)
            out[:, 7 * g + m] = x
    return out.view(np.int64)


def planes(symbols: np.ndarray) -> np.ndarray:
    """``(rows, planes)``: a bit of all 64 symbols of a row as one 64-bit word, for each of ``BITS``."""
    shifts = np.arange(SYMBOLS, dtype=np.uint64)
    bits = [(symbols >> np.uint32(k)) & np.uint32(1) for k in BITS]
    return np.stack([(b.astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64) for b in bits], 1).view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _tables(texts: DataFrame) -> DataFrame:
    """``(uid, keys, s0, s1, s2, s3)`` of ``(uid, kind_no, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _functions()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                kinds = part.column(1).to_numpy(zero_copy_only=False)
                sig = np.stack([signature(t, a, b) for t in part.column(2).to_pylist()])
                keys = np.empty((len(sig), 7 * GROUPS), np.int64)
                for kind in np.unique(kinds):
                    keys[kinds == kind] = mask_keys(sig[kinds == kind], int(kind))
                offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * (7 * GROUPS))
                lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
                s = planes(sig)
                columns = [part.column(0), lists, *(pa.array(s[:, k]) for k in range(len(BITS)))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "keys", "s0", "s1", "s2", "s3"])

    return texts.select("uid", "kind_no", "text").mapInArrow(
        run, "uid bigint, keys array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``(a, b)`` whose texts reach the threshold exactly, with ``similarity``."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    needed = texts.join(wanted, "uid", "left_semi").select("uid", "text")
    both = pairs.join(needed.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a").join(
        needed.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept = None, None
        for batch in batches:
            ids_a, ids_b, texts_a, texts_b = (batch.column(i) for i in range(4))
            values = np.empty(batch.num_rows)
            for i, b in enumerate(ids_b.to_pylist()):  # rows arrive sorted by b
                if b != kept_id:
                    kept_id, kept = b, np.unique(shingle_hashes(texts_b[i].as_py()))
                values[i] = jaccard(np.unique(shingle_hashes(texts_a[i].as_py())), kept)
            made = pa.RecordBatch.from_arrays([ids_a, ids_b, pa.array(values)], ["a", "b", "similarity"])
            yield made.filter(pa.array(values >= THRESHOLD))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, similarity double")


def prepare(collections: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """``(members, texts)`` of named collections of ``(key string, text)``.

    ``members`` is ``(kind, key, uid)``, where equal texts share a ``uid``; ``texts`` is ``(uid,
    kind_no, text)`` with one normalised text per uid.  Both are written tables.  Rows without key
    or text, and texts under 200 characters, are no cases and have no row.
    """
    rows = None
    for number, (kind, df) in enumerate(collections):
        one = df.select(
            F.lit(kind).alias("kind"), F.lit(number).alias("kind_no"), "key", normalised(F.col("text")).alias("text")
        )
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.where(F.col("key").isNotNull() & (F.length("text") >= MIN_CHARS))
    # A row number that is written once and so stays the same whatever is recomputed later.
    rows = written(
        rows.withColumn("digest", F.unhex(F.md5("text"))).withColumn("uid", F.monotonically_increasing_id()), "texts"
    )
    first = rows.groupBy("kind_no", "digest").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = written(first.where("n > 1").select("kind_no", "digest", "first"), "copies")
    known = rows.select("kind", "kind_no", "key", "uid", "digest").join(copies, ["kind_no", "digest"], "left")
    members = known.select("kind", "key", F.coalesce("first", "uid").alias("uid"))
    others = known.where(F.col("first").isNotNull() & (F.col("first") != F.col("uid"))).select("uid")
    return members, rows.select("uid", "kind_no", "text").join(others, "uid", "left_anti")


def similar_texts(texts: DataFrame) -> DataFrame:
    """``(a, b, similarity)`` with a < b of all pairs of different texts of one kind, as a written table."""
    rows = _tables(texts).select("uid", "s0", "s1", "s2", "s3", F.explode("keys").alias("key"))
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.bit_count(
        F.col("x.s0").bitwiseXOR(F.col("y.s0"))
        .bitwiseOR(F.col("x.s1").bitwiseXOR(F.col("y.s1")))
        .bitwiseOR(F.col("x.s2").bitwiseXOR(F.col("y.s2")))
        .bitwiseOR(F.col("x.s3").bitwiseXOR(F.col("y.s3")))
    )
    met = x.join(
        y.hint("merge"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.uid") < F.col("y.uid")) & (apart <= MAX_DIFFERENCES),
    )
    pairs = written(met.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct(), "candidates")
    return written(_verified(pairs, texts), "similar")


def near_copies(collections: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(kind, key_a, key_b)``: every pair of near copies, ``key_a`` < ``key_b`` bytewise.

    Pairs of equal texts are among them.  A row per pair is what is asked for here, so a group of m
    copies gives m * (m - 1) / 2 rows; :func:`groups` gives one row per record.
    """
    members, texts = prepare(collections)
    members = written(members, "members")
    pairs = similar_texts(texts)
    x = members.select("kind", F.col("key").alias("key_x"), F.col("uid").alias("a"))
    y = members.select(F.col("key").alias("key_y"), F.col("uid").alias("b"))
    different = pairs.join(x, "a").join(y, "b")
    shared = members.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid")
    copies = members.join(shared, "uid", "left_semi")
    equal = (
        copies.select("kind", F.col("key").alias("key_x"), "uid")
        .join(copies.select(F.col("key").alias("key_y"), "uid"), "uid")
        .where(F.col("key_x") < F.col("key_y"))
    )
    found = different.select("kind", "key_x", "key_y").unionByName(equal.select("kind", "key_x", "key_y"))
    return found.select(
        "kind", F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b")
    )


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the connected components of ``(a, b)``; the root is the least node.

    Alternating large-star and small-star steps over written edge tables; only counts and sums of
    the edge table reach the driver.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
        )
        edges = written(small.where("a <> b").distinct(), "edges")
        now = tuple(
            edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        )
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def groups(collections: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(kind, key, group_key, group_size, links)``: one row per record that is a case.

    Records connected through near copies share the least key of their group; ``links`` counts the
    record's near copies.  Exact copies are counted from class sizes and never expanded into pairs.
    """
    members, texts = prepare(collections)
    members = written(members, "members")
    pairs = similar_texts(texts)
    sizes = members.groupBy("uid").agg(F.count(F.lit(1)).alias("copies"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = (
        both.join(sizes.select(F.col("uid").alias("b"), "copies"), "b").groupBy(F.col("a").alias("uid"))
        .agg(F.sum("copies").alias("other"))
    )
    rooted = components(pairs)
    rows = (
        members.join(sizes, "uid").join(links, "uid", "left")
        .join(rooted.select(F.col("node").alias("uid"), "root"), "uid", "left")
        .select("kind", "key", F.coalesce("root", "uid").alias("root"),
                (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    )
    named = rows.groupBy("kind", "root").agg(F.min("key").alias("group_key"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(named, ["kind", "root"]).select("kind", "key", "group_key", "group_size", "links")


def corpus(docs: DataFrame, chunks: DataFrame) -> list[tuple[str, DataFrame]]:
    """The two collections of this project; repeated chunk rows count once."""
    return [
        ("document", docs.select(F.col("doc_id").cast("string").alias("key"), "text")),
        (
            "chunk",
            chunks.groupBy(F.concat("doc_id", F.lit("#"), F.col("chunk_no").cast("string")).alias("key"))
            .agg(F.min("text").alias("text")),
        ),
    ]
