"""Operation log folded into current state.

An op row is ``(lsn, op, ext_id, vec, meta)`` with op 1 Insert, 2 Update, 3 Delete.  State is three
independent "latest value" registers per key, so that the fold is a single order-insensitive
aggregation with map-side combine: a key that holds a tenth of the log shuffles one row per
input partition.  Replayed rows (same lsn) and late rows need no treatment of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = 1, 2, 3

META_VALUE = "struct<t:tinyint,i:bigint,d:double,s:string,b:boolean>"
META = f"map<string,{META_VALUE}>"


def valid_vector(vec: Column, dim: int | None) -> Column:
    """True where ``vec`` is not null, has ``dim`` elements (any number if None), all finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    sized = F.lit(True) if dim is None else F.size(vec) == dim
    return F.coalesce(vec.isNotNull() & sized & finite, F.lit(False))


def accepted(ops: DataFrame, dim: int | None) -> DataFrame:
    """Ops that may take effect: Deletes, and Inserts/Updates with a valid vector.

    Rejected: null or unknown op, null key or lsn, and vectors that are null, of another length
    or not finite.  Rejecting happens before the fold, as validation happens before the append.
    """
    return ops.where(
        F.col("ext_id").isNotNull()
        & F.col("lsn").isNotNull()
        & ((F.col("op") == DELETE) | (F.col("op").isin(INSERT, UPDATE) & valid_vector(F.col("vec"), dim)))
    )


def registers(with_meta: bool, meta_type: str = META) -> list[Column]:
    """The aggregates of the fold; they also run as a streaming aggregation."""
    op, lsn, vec = F.col("op"), F.col("lsn"), F.col("vec")
    out = [
        F.max_by(F.when(op.isin(INSERT, DELETE), op), F.when(op.isin(INSERT, DELETE), lsn)).alias("rop"),
        F.max_by(F.when(op != DELETE, vec), F.when(op != DELETE, lsn)).alias("vec"),
    ]
    if with_meta:
        meta = F.when(op == INSERT, F.coalesce(F.col("meta"), F.create_map().cast(meta_type))).when(
            op == UPDATE, F.col("meta")
        )
        out.append(F.max_by(meta, F.when(meta.isNotNull(), lsn)).alias("meta"))
    return out


def fold(ops: DataFrame, dim: int | None = None, with_meta: bool = True) -> DataFrame:
    """Current state ``(ext_id, vec[, meta])`` of the live keys.

    An Insert creates, overwrites or revives; an Update changes live keys only, and a null ``meta``
    keeps the old map while an empty one clears it; a Delete ends a key.  An empty log gives an
    empty state.  Columns besides those of an op are ignored.
    """
    meta_type = ops.schema["meta"].dataType.simpleString() if with_meta else META
    state = accepted(ops, dim).groupBy("ext_id").agg(*registers(with_meta, meta_type))
    return state.where(F.col("rop") == INSERT).drop("rop")


def promote(state: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """``state`` with a column for each metadata key of ``keys`` (key to column name): its tagged value."""
    for key, name in keys.items():
        if name in ("ext_id", "internal_id", "vec", "meta"):
            raise ValueError(f"{name} is a column of the state")
        state = state.withColumn(name, F.try_element_at("meta", F.lit(key)))
    return state


def effects(ops: DataFrame, dim: int | None = None) -> DataFrame:
    """``(lsn, op, ext_id, effective)``: whether each op changed anything.

    Inserts always do; Updates and Deletes do iff the key's last Insert or Delete before them is an
    Insert.  Repeated rows count once.  The log is cut into ranges of (key, lsn), so a key that holds
    much of it is spread over many tasks; each range is told the last Insert or Delete of its first key
    in the ranges before, from a table with a row per range.
    """
    from quillvec.session import written

    rows = accepted(ops, dim).select("lsn", "op", "ext_id").dropDuplicates(["ext_id", "lsn"])
    ranges = written(rows.repartitionByRange("ext_id", "lsn").withColumn("_part", F.spark_partition_id()), "ranges")
    reset = F.when(F.col("op") != UPDATE, F.col("op"))
    # Of every range: its first and last key, and its last Insert or Delete, which counts if it is of the last key.
    bounds = ranges.groupBy("_part").agg(
        F.min("ext_id").alias("_first"), F.max("ext_id").alias("_last"),
        F.max_by(F.struct("ext_id", "op"), F.when(reset.isNotNull(), F.struct("ext_id", "lsn"))).alias("_r"),
    )
    bounds = written(bounds, "bounds")  # a row per range
    ends = bounds.where(F.col("_r.ext_id") == F.col("_last")).select(
        F.col("_part").alias("_p"), F.col("_last").alias("_key"), F.col("_r.op").alias("_end")
    )
    carried = (
        bounds.join(F.broadcast(ends), (F.col("_first") == F.col("_key")) & (F.col("_p") < F.col("_part")), "left")
        .groupBy("_part", "_first").agg(F.max_by("_end", "_p").alias("_carried"))
    )
    before = Window.partitionBy("_part", "ext_id").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    within = F.last(reset, ignorenulls=True).over(before)
    told = ranges.join(F.broadcast(carried), "_part").withColumn(
        "_was", F.coalesce(within, F.when(F.col("ext_id") == F.col("_first"), F.col("_carried")))
    )
    return told.select("lsn", "op", "ext_id", ((F.col("op") == INSERT) | F.coalesce(F.col("_was") == INSERT, F.lit(False))).alias("effective"))


def slots(ops: DataFrame, dim: int | None = None) -> DataFrame:
    """``(ext_id, internal_id, live)``: dense slot ids in order of first Insert, dead slots kept.

    The numbering is exact without a single-task sort: keys are range-partitioned by first Insert,
    and each partition's offset comes from the (small) table of partition counts.
    """
    reset = F.when(F.col("op").isin(INSERT, DELETE), F.col("lsn"))
    keys = (
        accepted(ops, dim)
        .groupBy("ext_id")
        .agg(
            F.min(F.when(F.col("op") == INSERT, F.col("lsn"))).alias("first_insert"),
            F.max_by("op", reset).alias("rop"),
        )
        .where(F.col("first_insert").isNotNull())
    )
    numbered = dense_ids(keys, ["first_insert", "ext_id"], "internal_id")
    return numbered.select("ext_id", "internal_id", (F.col("rop") == INSERT).alias("live"))


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number the rows 0..n-1 in the given total order, in parallel.

    Range partitioning, a count per partition, and a running sum over those counts (one row per
    partition, so the driver-side-sized part is bounded by the number of partitions).
    """
    from quillvec.session import written

    part = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return (
        part.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_part", "_before")
    )


def compact(state: DataFrame, slot_table: DataFrame) -> DataFrame:
    """Live rows renumbered 0..n-1 in the order of their old slots."""
    live = state.join(slot_table.where("live").select("ext_id", F.col("internal_id").alias("old_id")), "ext_id")
    return dense_ids(live, ["old_id"], "internal_id").drop("old_id")


def with_snapshot(snapshot: DataFrame, snapshot_lsn: int, tail: DataFrame) -> DataFrame:
    """Ops equivalent to a snapshot of live rows and the log after it.

    Snapshot rows become Inserts at ``snapshot_lsn``; ops up to that lsn are already in it.
    """
    base = snapshot.select(
        F.lit(snapshot_lsn).cast("bigint").alias("lsn"), F.lit(INSERT).alias("op"), "ext_id", "vec", "meta"
    )
    return base.unionByName(tail.where(F.col("lsn") > snapshot_lsn).select("lsn", "op", "ext_id", "vec", "meta"))
