"""Collections of vectors, and the retrieval engine on top of them.

A :class:`Collection` is an operation log folded on read; all its results are DataFrames or single
values.  Bulk work goes through ``apply_ops``; the single-row methods are conveniences over it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.config import CollectionConfig, IndexKind, RagConfig, SyncPolicy
from quillvec.functions import filters
from quillvec.operators import ann, oplog, rag, search
from quillvec.operators.embed import EmbeddingModel, HashingModel
from quillvec.session import ship, written
from quillvec.sources.store import OPS, OpStore


class Collection:
    """Vectors of one dimension with metadata, searched under one metric.

    ``promoted`` maps metadata keys to columns: the state and its snapshots hold their tagged values
    in columns of their own, so that filters on them reach the scan of a snapshot.
    """

    def __init__(self, spark: SparkSession, config: CollectionConfig, promoted: Mapping[str, str] | None = None):
        self.spark, self.config = ship(spark), config
        self.promoted = dict(promoted or {})
        durable = config.persistence
        self._store = OpStore(spark, durable.path) if durable else None
        self._pending: list[tuple] = []  # appended, and not yet committed
        self._memory: DataFrame = spark.createDataFrame([], OPS)
        self._lsn = self._store.last_lsn() if self._store else 0
        self._index: ann.CellIndex | None = None

    # -- the log ----------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """All operations that count, pending ones included."""
        base = self._store.log() if self._store else self._memory
        return base.unionByName(self.spark.createDataFrame(self._pending, OPS)) if self._pending else base

    def state(self) -> DataFrame:
        """Live rows ``(ext_id, vec, meta)``, and the promoted columns.

        Keys that no operation since the snapshot names are read from it as they are; only the
        others are folded.
        """
        columns = ["ext_id", "vec", "meta", *self.promoted.values()]
        if self._store is None or not self._store.current()[0]:
            return oplog.promote(oplog.fold(self.log(), self.config.dim), self.promoted).select(columns)
        tail = self._store.tail()
        if self._pending:
            tail = tail.unionByName(self.spark.createDataFrame(self._pending, OPS))
        snapshot, touched = self._store.snapshot_state(self.promoted), tail.select("ext_id").distinct()
        same = snapshot.join(touched, "ext_id", "left_anti")
        old = snapshot.join(touched, "ext_id", "left_semi")
        changed = oplog.fold(oplog.with_snapshot(old, self._store.current()[1], tail), self.config.dim)
        return same.select(columns).unionByName(oplog.promote(changed, self.promoted).select(columns))

    def slots(self) -> DataFrame:
        """``(ext_id, internal_id, live)`` since the last compaction."""
        return oplog.slots(self.log(), self.config.dim)

    def _check(self, vec: Sequence[float]) -> list[float]:
        if len(vec) != self.config.dim:
            raise ValueError(f"vector of {len(vec)} elements, the collection has {self.config.dim}")
        if not all(math.isfinite(x) for x in vec):
            raise ValueError("vector with an element that is not finite")
        return [float(x) for x in vec]

    def _append(self, op: int, ext_id: str, vec: list[float] | None, meta: Any) -> None:
        self._lsn += 1
        self._pending.append((self._lsn, op, ext_id, vec, None if meta is None else filters.meta_map(meta)))
        self._index = None
        policy = self.config.persistence
        if policy and (policy.sync is SyncPolicy.ALWAYS or len(self._pending) >= policy.buffer):
            self._commit()

    def _commit(self) -> None:
        if self._pending:
            rows = self.spark.createDataFrame(self._pending, OPS)
            if self._store:
                self._store.append(rows)
            else:
                self._memory = self._memory.unionByName(rows)
            self._pending = []

    def insert(self, ext_id: str, vec: Sequence[float], meta: Mapping[str, Any] | None = None) -> int:
        """Insert or overwrite; returns the internal id."""
        self._append(oplog.INSERT, ext_id, self._check(vec), meta)
        return self.slots().where(F.col("ext_id") == ext_id).first()["internal_id"]

    def update(self, ext_id: str, vec: Sequence[float], meta: Mapping[str, Any] | None = None) -> bool:
        """Change a live vector; metadata None keeps the old, an empty one clears it.

        False, and nothing logged, if the id is not live.
        """
        checked = self._check(vec)
        if not self.is_live(ext_id):
            return False
        self._append(oplog.UPDATE, ext_id, checked, meta)
        return True

    def erase(self, ext_id: str) -> bool:
        if not self.is_live(ext_id):
            return False
        self._append(oplog.DELETE, ext_id, None, None)
        return True

    def apply_ops(self, ops: DataFrame, order: str = "lsn") -> DataFrame:
        """Append many operations ``(order, op, ext_id, vec, meta)`` in that order.

        Invalid vectors are an error before anything is appended.  Operations without effect are not
        logged.  Returns ``(order, op, ext_id, effective)``.
        """
        wrong = ops.where(F.col("op") != oplog.DELETE).where(~oplog.valid_vector(F.col("vec"), self.config.dim))
        if wrong.limit(1).count():
            raise ValueError(f"vectors that are not {self.config.dim} finite elements")
        self._commit()
        base = self._lsn
        meta = F.col("meta").cast(oplog.META) if "meta" in ops.columns else F.lit(None).cast(oplog.META)
        rows = ops.select(F.col(order).alias("_order"), "op", "ext_id", F.col("vec").cast("array<float>").alias("vec"), meta.alias("meta"))
        numbered = oplog.dense_ids(rows, ["_order", "ext_id", "op"], "_n").withColumn("lsn", F.col("_n") + base + 1)
        numbered = written(numbered, "batch")
        live = self.state().select("ext_id", "vec").withColumn("lsn", F.lit(base).cast("bigint")).withColumn("op", F.lit(oplog.INSERT))
        both = live.unionByName(numbered.select("ext_id", "vec", "lsn", "op"))
        effects = written(oplog.effects(both, self.config.dim).where(F.col("lsn") > base), "effects")
        kept = numbered.join(effects.where("effective").select("lsn"), "lsn", "left_semi").select("lsn", "op", "ext_id", "vec", "meta")
        if self._store:
            self._store.append(kept)
        else:
            self._memory = self._memory.unionByName(kept)
        self._lsn = numbered.agg(F.max("lsn")).first()[0] or base
        self._index = None
        return effects.join(numbered.select("lsn", F.col("_order").alias(order if order != "lsn" else "order")), "lsn").drop("lsn")

    # -- reads ------------------------------------------------------------------------------------

    def _row(self, ext_id: str):
        return self.state().where(F.col("ext_id") == ext_id).first()

    def get(self, ext_id: str) -> list[float] | None:
        row = self._row(ext_id)
        return None if row is None else list(row["vec"])

    def metadata(self, ext_id: str) -> dict[str, Any] | None:
        row = self._row(ext_id)
        if row is None:
            return None
        field = {filters.INT: "i", filters.DOUBLE: "d", filters.STRING: "s", filters.BOOL: "b"}
        return {k: v[field[v["t"]]] for k, v in row["meta"].items()}

    def is_live(self, ext_id: str) -> bool:
        return self._row(ext_id) is not None

    def resolve(self, ext_id: str) -> int | None:
        row = self.slots().where((F.col("ext_id") == ext_id) & F.col("live")).first()
        return None if row is None else row["internal_id"]

    def external_id(self, internal_id: int) -> str | None:
        row = self.slots().where(F.col("internal_id") == internal_id).first()
        return None if row is None else row["ext_id"]

    def size(self) -> int:
        return self.state().count()

    def slot_count(self) -> int:
        return self.slots().count()

    @property
    def dim(self) -> int:
        return self.config.dim

    def stats(self) -> DataFrame:
        """One row ``(dim, metric, index, size, slots)``."""
        size = self.state().agg(F.count(F.lit(1)).alias("size"))
        slots = self.slots().agg(F.count(F.lit(1)).alias("slots"))
        return size.crossJoin(slots).select(
            F.lit(self.config.dim).alias("dim"), F.lit(self.config.metric.value).alias("metric"),
            F.lit(self.config.index.value).alias("index"), "size", "slots",
        )

    # -- search -----------------------------------------------------------------------------------

    def search(
        self, query: Sequence[float], k: int = 10, where: filters.Filter | None = None, ef: int | None = None
    ) -> DataFrame:
        """``(ext_id, score)`` of the k nearest live rows that pass ``where``."""
        point = self._check(query)
        if self.config.index is IndexKind.IVF and k > 0:
            asked = self.spark.createDataFrame([(0, point)], "qid int, qv array<double>")
            return self.search_batch(asked, k, where, ef).orderBy("rank_no").select("ext_id", "score")
        rows = filters.where(self.state(), where, promoted=self.promoted)
        return search.knn_single(rows, point, k, self.config.metric)

    def search_batch(
        self, queries: DataFrame, k: int = 10, where: filters.Filter | None = None, ef: int | None = None
    ) -> DataFrame:
        """``(qid, rank_no, ext_id, score)`` for ``(qid, qv)``; a wrong vector is an error up front."""
        if queries.where(~oplog.valid_vector(F.col("qv"), self.config.dim)).limit(1).count():
            raise ValueError(f"queries that are not {self.config.dim} finite elements")
        if self.config.index is IndexKind.IVF and k > 0:
            if self._index is None:
                self._index = ann.build(self.state(), self.config.metric, self.config.ann)
            allowed = None if where is None else filters.Compiler(self._index.rows, promoted=self.promoted).column(where)
            return ann.search(self._index, queries, k, allowed, ef)
        return search.knn(filters.where(self.state(), where, promoted=self.promoted), queries, k, self.config.metric)

    # -- durability -------------------------------------------------------------------------------

    @property
    def durable(self) -> bool:
        return self._store is not None

    def flush(self) -> None:
        """Commit what is held back; does nothing under the policy ``OFF``."""
        if self._store is None or self.config.persistence.sync is not SyncPolicy.OFF:
            self._commit()

    def close(self) -> None:
        self._commit()

    def snapshot(self) -> None:
        """Write the state as a new version and drop the log it covers; nothing if not durable."""
        if self._store is None:
            return
        self._commit()
        self._publish(self.state().join(self.slots().where("live").select("ext_id", "internal_id"), "ext_id"))

    def _publish(self, rows: DataFrame) -> None:
        self._store.publish(rows, self._lsn, self.promoted)
        self._store.truncate()

    def compact(self) -> None:
        """Renumber the live rows from 0 in the order of their slots; a snapshot if durable."""
        self._commit()
        rows = written(oplog.compact(self.state(), self.slots()), "compacted")
        if self._store:
            self._publish(rows)
        else:
            # The new log: one Insert per live row, in slot order, before all later operations.
            count = rows.count()
            base = self._lsn
            self._memory = rows.select(
                (F.col("internal_id") + base + 1).alias("lsn"), F.lit(oplog.INSERT).alias("op"), "ext_id", "vec", "meta"
            )
            self._lsn = base + count
        self._index = None


class RagEngine:
    """Documents in, prompts out."""

    def __init__(self, spark: SparkSession, config: RagConfig = RagConfig(), model: EmbeddingModel | None = None):
        self.spark, self.config = ship(spark), config
        self.model = model or HashingModel(config.embed_dim)
        self._index: tuple[DataFrame, ann.CellIndex] | None = None
        self._chunks = rag.ingest(spark.createDataFrame([], "doc_id string, text string"), self.model, config.chunk)

    def chunks(self) -> DataFrame:
        return self._chunks

    def ingest(self, doc_id: str, text: str) -> int:
        """Replace a document; returns its number of chunks.  Without tokens it becomes unknown."""
        docs = self.spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
        self.ingest_all(docs)
        return self._chunks.where(F.col("doc_id") == doc_id).count()

    def ingest_all(self, docs: DataFrame) -> None:
        """Replace documents ``(doc_id, text)``, one row each."""
        self._chunks = written(rag.reingest(self._chunks, docs, self.model, self.config.chunk), "chunks")

    def remove(self, doc_id: str) -> bool:
        known = self._chunks.where(F.col("doc_id") == doc_id).limit(1).count() > 0
        if known:
            self._chunks = written(self._chunks.where(F.col("doc_id") != doc_id), "chunks")
        return known

    def document_count(self) -> int:
        return rag.document_count(self._chunks).first()["documents"]

    def _hits(self, asked: DataFrame, k: int) -> DataFrame:
        """Hits by the index of the configuration, which is kept until the chunks change."""
        if self.config.index is IndexKind.IVF and (self._index is None or self._index[0] is not self._chunks):
            self._index = self._chunks, ann.build(self._chunks, self.config.metric, self.config.ann)
        index = self._index[1] if self.config.index is IndexKind.IVF else None
        return rag.retrieve(self._chunks, asked, self.model, k, self.config, index)

    def retrieve(self, question: str, k: int | None = None) -> DataFrame:
        """``(rank_no, doc_id, text, score)``."""
        asked = self.spark.createDataFrame([(0, question)], "qid int, question string")
        hits = self._hits(asked, self.config.retrieve_k if k is None else k)
        return hits.orderBy("rank_no").select("rank_no", "doc_id", "text", "score")

    def build_prompt(self, question: str) -> str:
        asked = self.spark.createDataFrame([(0, question)], "qid int, question string")
        hits = self._hits(asked, self.config.retrieve_k)
        return rag.prompts(hits, asked, self.config.token_budget).first()["prompt"]

    def stats(self) -> DataFrame:
        """One row ``(metric, index, dim, documents, chunks)``."""
        return self._chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("chunks")).select(
            F.lit(self.config.metric.value).alias("metric"), F.lit(self.config.index.value).alias("index"),
            F.lit(self.model.dim).alias("dim"), "documents", "chunks",
        )


