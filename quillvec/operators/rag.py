"""Retrieval pipeline: documents to chunks, embeddings, hits and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillvec.config import ChunkConfig, IndexKind, RagConfig
from quillvec.functions import text as T
from quillvec.operators import ann, search
from quillvec.operators.embed import EmbeddingModel, HashingModel

SCAFFOLD = 24  # tokens that the fixed text of a prompt is reckoned at

# The literal text of a prompt.
INSTRUCTION = "You are a helpful assistant. Answer using only the context below."


def latest(docs: DataFrame, version: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the last version of each document."""
    last = docs.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    return last.agg(F.max_by(F.struct(F.col(text).alias("text")), version).alias("_l")).select("doc_id", "_l.text")


def ingest(docs: DataFrame, model: EmbeddingModel, chunk: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``(ext_id, doc_id, chunk_no, start_token, end_token, text, vec)`` of all chunks.

    A chunk's id is ``doc_id#chunk_no``.  A document without tokens has no chunks and so is unknown.
    """
    return T.chunks(docs, chunk).select(
        F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("chunk_no").cast("string")).alias("ext_id"),
        "doc_id", "chunk_no", "start_token", "end_token", "text", model.column(F.col("text")).alias("vec"),
    )


def reingest(chunks: DataFrame, docs: DataFrame, model: EmbeddingModel, chunk: ChunkConfig = ChunkConfig()) -> DataFrame:
    """``chunks`` with those of ``docs`` in place of the documents' earlier ones."""
    return remove(chunks, docs.select("doc_id")).unionByName(ingest(docs, model, chunk))


def remove(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """``chunks`` without those of the given documents; unknown ones change nothing."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def document_count(chunks: DataFrame) -> DataFrame:
    """One row ``documents``: documents with at least one chunk."""
    return chunks.agg(F.countDistinct("doc_id").alias("documents"))


def retrieve(
    chunks: DataFrame, questions: DataFrame, model: EmbeddingModel, k: int, config: RagConfig = RagConfig(),
    index: ann.CellIndex | None = None,
) -> DataFrame:
    """``(qid, rank_no, doc_id, chunk_no, text, score)`` for ``(qid, question)``.

    By exact search, or by ``index``; with ``config.index`` IVF and no index, one is built for the call.
    A chunk without text comes out with an empty one.
    """
    asked = questions.select("qid", model.column(F.col("question")).alias("qv"))
    if config.index is IndexKind.IVF and k > 0:
        hits = ann.search(index or ann.build(chunks, config.metric, config.ann), asked, k)
    else:
        hits = search.knn(chunks, asked, k, config.metric)
    return hits.join(chunks.select("ext_id", "doc_id", "chunk_no", "text"), "ext_id").select(
        "qid", "rank_no", "doc_id", "chunk_no", F.coalesce("text", F.lit("")).alias("text"), "score"
    )


def within_budget(retrieved: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """The retrieved chunks that fit a prompt of ``budget`` tokens.

    The question's tokens and the fixed text are reserved.  Chunks are taken by rank up to the first
    that does not fit; as costs are not negative, that is where the running sum passes the rest.
    """
    asked = questions.select("qid", T.token_count(F.col("question")).alias("_asked"))
    running = Window.partitionBy("qid").orderBy("rank_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = retrieved.join(asked, "qid").withColumn("_cost", F.sum(T.token_count(F.col("text"))).over(running))
    room = F.greatest(F.lit(0), F.lit(budget) - F.col("_asked") - F.lit(SCAFFOLD))
    return rows.where(F.col("_cost") <= room).drop("_cost", "_asked")


def prompt(bullets: Column, question: Column) -> Column:
    """The prompt's text from the bullets' text and the question."""
    return F.concat(
        F.lit(INSTRUCTION + "\n\nContext:\n"), bullets, F.lit("\nQuestion: "), question, F.lit("\nAnswer:")
    )


def prompts(retrieved: DataFrame, questions: DataFrame, budget: int) -> DataFrame:
    """``(qid, bullets, prompt)`` of every question, also of those without a chunk."""
    kept = within_budget(retrieved, questions, budget)
    lists = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank_no", "text"))).alias("_c"))
    lines = F.coalesce(
        F.concat_ws("", F.transform("_c", lambda c: F.concat(F.lit("- "), c["text"], F.lit("\n")))), F.lit("")
    )
    return questions.join(lists, "qid", "left").select(
        "qid", F.coalesce(F.size("_c"), F.lit(0)).alias("bullets"),
        prompt(lines, F.coalesce("question", F.lit(""))).alias("prompt"),
    )


def default_model(config: RagConfig = RagConfig()) -> EmbeddingModel:
    return HashingModel(config.embed_dim)
