"""Filling fixed-capacity containers with texts (problem 7).

Bulk-synchronous best fit.  Items (texts sized in tokens) and gaps (free room of open containers)
are both kept sorted by size.  A superstep places one size, largest first: the items look up their
successor among the gaps, the smallest gap that still holds them; items that want the same gap are
told apart by rank, so that the first of them fill it and the others look up the next successor;
the gaps are updated and the next superstep begins.  Items that find no gap open containers.

Texts of equal size are interchangeable, and so are equal gaps, so a superstep works on size
classes with counts and rank ranges instead of rows.  There are at most ``capacity`` classes of
either, however many texts there are: that table of classes is all the driver ever holds, and the
plan it makes is a list of rank ranges.  The rows themselves stay distributed: they are counted per
(partition, size), ranked within their size from those counts, and given their container by a join
with the plan.  No size, however frequent, is gathered into one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillvec.llm import bpe
from quillvec.session import written

MAX_CAPACITY = 1_000_000  # bound of the class table; larger capacities are refused
RANK_BITS = 40  # of a 64-bit word, for the rank of a row within its size


@dataclass(frozen=True)
class Run:
    """Items ``first .. first + count - 1`` of one size.

    They go to containers ``base, base + 1, ...``, ``each`` items to a container.
    """

    size: int
    first: int
    count: int
    base: int
    each: int


class _Gaps:
    """Open containers by free room; containers of one room are kept as ranges."""

    def __init__(self) -> None:
        self.sizes: list[int] = []  # sorted, those with containers
        self.ranges: dict[int, list[tuple[int, int]]] = {}  # room -> [(base, count)]

    def add(self, room: int, base: int, count: int) -> None:
        if room > 0 and count > 0:
            if room not in self.ranges:
                insort(self.sizes, room)
                self.ranges[room] = []
            self.ranges[room].append((base, count))

    def successor(self, size: int) -> int | None:
        at = bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, room: int) -> tuple[int, int]:
        ranges = self.ranges[room]
        out = ranges.pop()
        if not ranges:
            del self.ranges[room]
            del self.sizes[bisect_left(self.sizes, room)]
        return out


def plan(classes: Iterable[tuple[int, int]], capacity: int, first_container: int = 0) -> list[Run]:
    """Best-fit placement of ``(size, count)`` classes, sizes from 1 to ``capacity``."""
    gaps, runs, containers = _Gaps(), [], first_container
    for size, count in sorted(classes, reverse=True):
        done = 0
        while done < count:
            room = gaps.successor(size)
            if room is None:
                each = capacity // size
                need = -(-(count - done) // each)
                base, number, room = containers, need, capacity
                containers += need
            else:
                base, number = gaps.take(room)
            each, left = room // size, count - done
            full = min(number, left // each)  # containers that get ``each`` items
            if full:
                runs.append(Run(size, done, full * each, base, each))
                gaps.add(room - each * size, base, full)
                done += full * each
            rest, at = count - done, full
            if at < number and 0 < rest < each:  # the last, partly filled one
                runs.append(Run(size, done, rest, base + at, rest))
                gaps.add(room - rest * size, base + at, 1)
                done, at = count, at + 1
            gaps.add(room, base + at, number - at)
    return runs


def _items(sizes: DataFrame, capacities: list[tuple[int, int]], key: str) -> DataFrame:
    """``(pack_id, key, piece_no, n_tokens, size)``: texts above a capacity in pieces of it."""
    packs = F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).alias("cap")) for p, c in capacities])
    each = sizes.select(key, "n_tokens", F.explode(packs).alias("_p")).select(
        "_p.pack_id", "_p.cap", key, "n_tokens"
    )
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / F.col("cap")).cast("int") - 1)
    pieces = each.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    size = F.least(F.col("cap"), F.col("n_tokens") - F.col("piece_no") * F.col("cap")).cast("int")
    return pieces.select("pack_id", key, "piece_no", "n_tokens", size.alias("size"))


def pack(sizes: DataFrame, config: DataFrame, key: str = "doc_id") -> DataFrame:
    """Assign sized texts to containers of each capacity.

    ``sizes`` has ``(key, n_tokens)``; ``config`` has ``(pack_id, capacity)``, fixed and small.
    Returns ``(pack_id, key, piece_no, size, container_no)``.  A text above the capacity is cut
    into pieces of exactly the capacity and a rest; no other is cut.  A text without tokens (null
    or 0) needs no room and has a null container.  Rows of ``config`` that are null or not
    positive are left out; of several rows for one ``pack_id`` the smallest capacity holds.  Null
    keys and repeated rows are items like any other.
    """
    spark = sizes.sparkSession
    rows = (
        config.where((F.col("capacity") > 0) & F.col("pack_id").isNotNull())
        .groupBy("pack_id")
        .agg(F.min("capacity").alias("capacity"))
        .orderBy("pack_id")
        .limit(1001)
        .collect()
    )
    capacities = [(r["pack_id"], r["capacity"]) for r in rows]
    if len(capacities) > 1000 or any(c > MAX_CAPACITY for _, c in capacities):
        raise ValueError(f"at most 1000 packs and capacities up to {MAX_CAPACITY}")
    pack_type, key_type = config.schema["pack_id"].dataType.simpleString(), sizes.schema[key].dataType.simpleString()
    out = f"pack_id {pack_type}, {key} {key_type}, piece_no int, size int, container_no bigint"
    if not capacities:
        return spark.createDataFrame([], out)

    clean = sizes.select(key, F.greatest(F.lit(0), F.coalesce("n_tokens", F.lit(0))).cast("int").alias("n_tokens"))
    # Partition numbers are written with the rows, so that a recomputed task cannot change ranks.
    items = written(
        _items(clean, capacities, key).withColumn("pack_id", F.col("pack_id").cast(pack_type))
        .withColumn("_part", F.spark_partition_id()),
        "items",
    )
    sized = items.where("size > 0")
    per_part = sized.groupBy("pack_id", "size", "_part").agg(F.count(F.lit(1)).alias("_n"))
    classes = per_part.groupBy("pack_id", "size").agg(F.sum("_n").alias("n")).collect()  # <= sum of capacities

    runs: list[tuple[int, Run]] = []
    for pack_id, capacity in capacities:
        own = [(r["size"], r["n"]) for r in classes if r["pack_id"] == pack_id]
        runs += [(pack_id, r) for r in plan(own, capacity)]
    table = pd.DataFrame(
        {
            "pack_id": [p for p, _ in runs],
            "size": np.array([r.size for _, r in runs], np.int32),
            "first": np.array([r.first for _, r in runs], np.int64),
            "count": np.array([r.count for _, r in runs], np.int64),
            "base": np.array([r.base for _, r in runs], np.int64),
            "each": np.array([r.each for _, r in runs], np.int64),
        }
    )
    if not runs:
        return items.select("pack_id", key, "piece_no", "size", F.lit(None).cast("bigint").alias("container_no"))

    # Rank within the size: rows before in earlier partitions, and rows before in this one.
    earlier = Window.partitionBy("pack_id", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        "pack_id", "size", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    within = Window.partitionBy("pack_id", "size", "_part").orderBy(key, "piece_no")
    ranked = sized.withColumn("_in", F.row_number().over(within) - 1).join(offsets, ["pack_id", "size", "_part"])
    ranked = ranked.select("pack_id", key, "piece_no", "size", (F.col("_before") + F.col("_in")).alias("_rank"))

    # All runs in one array sorted by (class, first rank); a row finds its run by binary search.
    table["class"] = table.groupby(["pack_id", "size"], sort=True).ngroup().astype(np.int64)
    table = table.sort_values(["class", "first"], ignore_index=True)
    names = table.drop_duplicates("class")[["pack_id", "size", "class"]].set_index(["pack_id", "size"])["class"]
    arrays = (names, *(table[c].to_numpy() for c in ("class", "first", "base", "each")))
    shared = spark.sparkContext.broadcast(arrays)  # bounded by the capacities, not by the texts

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, cls, first, base, each = shared.value
        points = (cls << RANK_BITS) | first
        for batch in batches:
            own = names.reindex(pd.MultiIndex.from_frame(batch[["pack_id", "size"]])).to_numpy()
            rank = batch["_rank"].to_numpy()
            at = np.searchsorted(points, (own.astype(np.int64) << RANK_BITS) | rank, side="right") - 1
            batch["container_no"] = base[at] + (rank - first[at]) // each[at]
            yield batch[["pack_id", key, "piece_no", "size", "container_no"]]

    placed = ranked.mapInPandas(place, out)
    roomless = items.where("size <= 0").select(
        "pack_id", key, "piece_no", "size", F.lit(None).cast("bigint").alias("container_no")
    )
    return placed.unionByName(roomless)


def pack_texts(docs: DataFrame, config: DataFrame, tokenizer: str = bpe.DEFAULT_TOKENIZER) -> DataFrame:
    """:func:`pack` for texts, sized by the public tokenizer."""
    return pack(bpe.count_tokens(docs, "doc_id", "text", tokenizer), config)


def fill_report(packed: DataFrame, config: DataFrame) -> DataFrame:
    """``(pack_id, capacity, containers, tokens, least_possible, unused_share)`` of each capacity."""
    one = config.groupBy("pack_id").agg(F.min("capacity").alias("capacity"))
    used = packed.groupBy("pack_id").agg(
        (F.max("container_no") + 1).alias("containers"), F.sum("size").alias("tokens")
    )
    room = F.col("containers") * F.col("capacity")
    return used.join(one, "pack_id").select(
        "pack_id",
        "capacity",
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / F.col("capacity")).alias("least_possible"),
        ((room - F.col("tokens")) / room).alias("unused_share"),
    )
