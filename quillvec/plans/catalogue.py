"""Queries of the engine's operators over the test tables, and the SQL that they equal.

Scores are ranked unrounded, ties by id, and shown with six decimals.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.config import AnnParams, ChunkConfig, CollectionConfig, Metric, Persistence, RagConfig
from quillvec.engine import Collection, RagEngine
from quillvec.functions import codec, filters, jsonio, text as T
from quillvec.functions.filters import all_of, any_of, eq, from_json, ge, gt, is_in, le, lt, ne, negate
from quillvec.operators import ann, embed, evaluation, oplog, rag, search
from quillvec.session import shared_dir, table, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

K = 10


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# -- search over the table of embeddings ------------------------------------------------------------

_VECTOR_SQL = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
q AS (SELECT vec_id AS qid, v AS qv FROM e WHERE vec_id % 50 = 0),
"""
_SCORE_SQL = {
    "l2": "list_reduce(list_transform(list_zip(v, qv), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x, 0.0)",
    "dot": "-list_reduce(list_transform(list_zip(v, qv), lambda p: p[1] * p[2]), lambda s, x: s + x, 0.0)",
}
_SCORE_SQL["cosine"] = (
    "CASE WHEN nv * nq = 0 THEN 1.0 ELSE 1.0 - greatest(-1.0, least(1.0, "
    "list_reduce(list_transform(list_zip(v, qv), lambda p: p[1] * p[2]), lambda s, x: s + x, 0.0) / (nv * nq))) END"
)
_NORM = "sqrt(list_reduce(list_transform({0}, lambda x: x * x), lambda s, x: s + x, 0.0))"


def knn_sql(metric: str = "l2", k: int = K, where: str = "true") -> str:
    return _VECTOR_SQL + f"""
n AS (SELECT q.qid, q.qv, {_NORM.format('q.qv')} AS nq FROM q),
r AS (SELECT vec_id, v, {_NORM.format('v')} AS nv FROM e WHERE {where}),
s AS (SELECT qid, vec_id, {_SCORE_SQL[metric]} AS score FROM r CROSS JOIN n),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, vec_id) AS rank_no FROM s)
SELECT qid, CAST(rank_no AS INTEGER) AS rank_no, vec_id, round(score, 6) AS score FROM t WHERE rank_no <= {k}
"""


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("embedding").isNotNull())


def _asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


def _knn(metric: str, where: filters.Filter | None = None, k: int = K, kernel: str = "auto") -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _embeddings(spark, d)
        kept = filters.where(rows, where, promoted={"label": "label", "vec_id": "vec_id"})
        return _shown(search.knn(kept, _asked(rows), k, metric, "vec_id", "embedding", kernel))

    return run


for _m in Metric:
    query(f"knn_{_m.value}", knn_sql(_m.value))(_knn(_m.value))
    query(f"knn_blocks_{_m.value}", knn_sql(_m.value))(_knn(_m.value, kernel="blocks"))
for _name, _filter, _where in (
    ("eq", eq("label", 3), "label = 3"),
    ("ne", ne("label", 3), "label <> 3"),
    ("range", all_of(ge("label", 2), lt("label", 5)), "label >= 2 AND label < 5"),
    ("in", is_in("label", [1, 4, 7]), "label IN (1, 4, 7)"),
    ("not", negate(eq("label", 3)), "NOT coalesce(label = 3, false)"),
    (
        "nested",
        any_of(all_of(gt("label", 6), le("vec_id", 300)), negate(any_of(eq("label", 1), eq("absent", 5)))),
        "(label > 6 AND vec_id <= 300) OR NOT coalesce(label = 1, false)",
    ),
    ("incomparable", negate(ne("label", "3")), "true"),
    ("json", from_json({"label": 2}), "label = 2"),
    ("empty_in", is_in("label", []), "false"),
):
    query(f"knn_filtered_{_name}", knn_sql("l2", where=_where))(_knn("l2", _filter))
query("knn_k_zero", knn_sql("l2", 0))(_knn("l2", k=0))
query("knn_k_huge", knn_sql("l2", 1_000_000))(_knn("l2", k=1_000_000))


@query(
    "knn_single",
    _VECTOR_SQL + f"""
o AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, {_SCORE_SQL['l2']} AS score FROM e CROSS JOIN o)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score, vec_id LIMIT {K}
""",
)
def knn_single(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    first = rows.orderBy("vec_id").select("embedding").first()
    return _shown(search.knn_single(rows, first[0] if first else [], K, Metric.L2, "vec_id", "embedding"))


@query("ann_full_probe", knn_sql("l2"))
def ann_full_probe(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    index = ann.build(rows, Metric.L2, id="vec_id", vec="embedding")
    return _shown(ann.search(index, _asked(rows), K, all_cells=True))


@query("ann_search")
def ann_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    index = ann.build(rows, Metric.COSINE, AnnParams(ef=200), id="vec_id", vec="embedding")
    return _shown(ann.search(index, _asked(rows), K))


@query("ann_filtered", knn_sql("l2", where="label = 3"))  # so few rows pass that all of them are compared
def ann_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    index = ann.build(rows, Metric.L2, AnnParams(ef=200), id="vec_id", vec="embedding")
    return _shown(ann.search(index, _asked(rows), K, F.col("label") == 3))


@query("ann_recall_floor", "SELECT true AS reached")
def ann_recall_floor(spark: SparkSession, d: str) -> DataFrame:
    """Whether the approximate search finds at least 0.9 of the exact results."""
    rows = _embeddings(spark, d)
    index = ann.build(rows, Metric.L2, AnnParams(ef=200), id="vec_id", vec="embedding")
    found = ann.search(index, _asked(rows), K)
    truth = search.knn(rows, _asked(rows), K, Metric.L2, "vec_id", "embedding")
    return evaluation.recall_at_k(found, truth, K, "vec_id").select((F.col("recall") >= 0.9).alias("reached"))


@query("ann_cells")
def ann_cells(spark: SparkSession, d: str) -> DataFrame:
    return ann.build(_embeddings(spark, d), Metric.L2, id="vec_id", vec="embedding").stats()


# -- metadata ---------------------------------------------------------------------------------------


def _meta_query(f: filters.Filter) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ops = table(spark, d, "op_log").select("lsn", "meta").dropDuplicates(["lsn"])
        return filters.where(ops, f).select("lsn")

    return run


_META_SQL = "SELECT lsn FROM (SELECT DISTINCT ON (lsn) lsn, meta FROM op_log) WHERE {0}"
_YEAR = "coalesce(CASE meta['year'].t WHEN 0 THEN meta['year'].i {0} WHEN 1 THEN meta['year'].d {0} END, false)"
_LANG = "coalesce(CASE WHEN meta['lang'].t = 2 THEN meta['lang'].s {0} END, false)"
for _name, _filter, _where in (
    ("meta_eq", eq("lang", "en"), _LANG.format("= 'en'")),
    ("meta_ne", ne("lang", "en"), _LANG.format("<> 'en'")),
    ("meta_not_eq", negate(eq("lang", "en")), "NOT " + _LANG.format("= 'en'")),
    ("meta_range", all_of(ge("year", 1880), lt("year", 1900)), _YEAR.format(">= 1880") + " AND " + _YEAR.format("< 1900")),
    ("meta_in", is_in("lang", ["de", "fr"]), _LANG.format("IN ('de', 'fr')")),
    ("meta_missing", eq("absent", 1), "false"),
    ("meta_not_missing", negate(eq("absent", 1)), "true"),
    ("meta_string_order", gt("lang", "f"), _LANG.format("> 'f'")),
):
    query(_name, _META_SQL.format(_where))(_meta_query(_filter))


@query(
    "filter_missing_key",
    "SELECT d.doc_id FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l "
    "ON d.doc_id = l.doc_id WHERE NOT coalesce(l.quality >= 3, false)",
)
def filter_missing_key(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left")
    return filters.where(joined, negate(ge("quality", 3)), promoted={"quality": "quality"}).select("doc_id")


@query(
    "json_filter",
    "SELECT event_id FROM events WHERE coalesce(CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') "
    "THEN CAST(json_extract_string(props, '$.k') AS BIGINT) = 69 END, false)",
)
def json_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return filters.where(rows, from_json({"k": 69}), promoted={"k": "k"}).select("event_id")


@query(
    "json_metadata",
    "SELECT event_id FROM events WHERE coalesce(CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') "
    "THEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50 END, false)",
)
def json_metadata(spark: SparkSession, d: str) -> DataFrame:
    """A range filter on metadata that are read from JSON text."""
    rows = table(spark, d, "events").select("event_id", jsonio.metadata(F.col("props")).alias("meta"))
    return filters.where(rows, ge("k", 50)).select("event_id")


# -- texts ------------------------------------------------------------------------------------------

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = "list_filter(regexp_split_to_array(" + _LOWER + ", '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"
_DOC_TOKENS = f"SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents WHERE text IS NOT NULL"


@query("tokens", f"SELECT doc_id, coalesce(len({_TOKENS.format('text')}), 0) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


def chunk_sql(window: int, overlap: int, docs: str = _DOC_TOKENS) -> str:
    w, o = ChunkConfig(window, overlap).effective
    return f"""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, CAST(i * {w - o} AS INTEGER) AS start_token,
       CAST(least(len(t), i * {w - o} + {w}) AS INTEGER) AS end_token,
       array_to_string(t[i * {w - o} + 1 : i * {w - o} + {w}], ' ') AS text
FROM (SELECT doc_id, t, unnest(range(0, CAST(greatest(0, ceil((len(t) - {w}) / {float(w - o)})) AS BIGINT) + 1)) AS i
      FROM ({docs}) WHERE len(t) > 0)
"""


for _w, _o in ((64, 16), (12, 4)):
    query(f"chunks_{_w}_{_o}", chunk_sql(_w, _o))(
        lambda spark, d, w=_w, o=_o: T.chunks(table(spark, d, "documents"), ChunkConfig(w, o))
    )

_FNV = (
    "list_reduce(list_transform(range(1, octet_length(encode(token)) + 1), lambda i: "
    "CAST(CAST('0x' || substr(hex(encode(token)), 2 * i - 1, 2) AS INTEGER) AS HUGEINT)), "
    "lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616, CAST(1469598103934665603 AS HUGEINT))"
)
_VOCABULARY = f"SELECT DISTINCT unnest(t) AS token FROM ({_DOC_TOKENS})"


@query("token_fnv", f"SELECT token, CAST(h // 4294967296 AS BIGINT) AS hi, CAST(h % 4294967296 AS BIGINT) AS lo FROM (SELECT token, {_FNV} AS h FROM ({_VOCABULARY}))")
def token_fnv(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return words.select("token", T.fnv_halves(F.col("token")).alias("h")).select("token", "h.hi", "h.lo")


_SPARSE = f"""
counted AS (SELECT {{keys}}, token, count(*) AS n FROM (SELECT {{keys}}, unnest({_TOKENS.format('text')}) AS token FROM {{source}})
            WHERE octet_length(encode(token)) >= 3 GROUP BY {{keys}}, token),
vocabulary AS (SELECT token, CAST(h % {{dim}} AS INTEGER) AS idx, CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END AS sign
               FROM (SELECT token, {_FNV} AS h FROM (SELECT DISTINCT token FROM counted))),
sums AS (SELECT {{keys}}, idx, CAST(sum(sign * n) AS DOUBLE) AS s FROM counted JOIN vocabulary USING (token) GROUP BY {{keys}}, idx),
sparse AS (SELECT {{keys}}, idx, s / sqrt(sum(s * s) OVER (PARTITION BY {{keys}})) AS weight FROM sums WHERE s <> 0)
"""


@query(
    "embed_chunks",
    f"WITH c AS ({chunk_sql(64, 16)}), " + _SPARSE.format(keys="doc_id, chunk_no", source="c", dim=128)
    + "SELECT doc_id, chunk_no, idx, round(weight, 6) AS weight FROM sparse",
)
def embed_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = T.chunks(table(spark, d, "documents"), ChunkConfig(64, 16))
    sparse = embed.embed_sparse(made, ["doc_id", "chunk_no"])
    return sparse.withColumn("weight", F.round("weight", 6))


# -- retrieval: the table of chunks, with texts of the least chunk per query as questions --------------


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    known = F.col("text").isNotNull() & F.col("doc_id").isNotNull() & F.col("chunk_no").isNotNull()
    return table(spark, d, "chunks").where(known).groupBy("doc_id", "chunk_no").agg(F.min("text").alias("text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every query id divisible by 50, with one of its retrieved texts as the question."""
    rows = table(spark, d, "retrieved").where((F.col("qid") % 50 == 0) & F.col("text").isNotNull())
    return rows.groupBy("qid").agg(F.min("text").alias("question"))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    model = rag.default_model()
    key = F.concat("doc_id", F.lit("#"), F.col("chunk_no").cast("string"))
    return _corpus(spark, d).select(key.alias("ext_id"), "doc_id", "chunk_no", "text", model.column(F.col("text")).alias("vec"))


@query("rag_retrieve")
def rag_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _shown(rag.retrieve(_embedded(spark, d), _questions(spark, d), rag.default_model(), 5))


@query("rag_prompt")
def rag_prompt(spark: SparkSession, d: str) -> DataFrame:
    asked = _questions(spark, d)
    return rag.prompts(rag.retrieve(_embedded(spark, d), asked, rag.default_model(), 5), asked, RagConfig().token_budget)


_BUDGET_SQL = f"""
WITH r AS (SELECT DISTINCT qid, rank_no, text FROM retrieved WHERE text IS NOT NULL AND rank_no IS NOT NULL AND qid IS NOT NULL),
one AS (SELECT qid, rank_no, min(text) AS text FROM r GROUP BY qid, rank_no),
costs AS (SELECT qid, rank_no, text, sum(len({_TOKENS.format('text')})) OVER (PARTITION BY qid ORDER BY rank_no) AS cost FROM one),
kept AS (SELECT * FROM costs WHERE cost <= 512 - 2 - 24),
asked AS (SELECT DISTINCT qid FROM one)
SELECT a.qid, CAST(coalesce(b.n, 0) AS INTEGER) AS bullets,
       'You are a helpful assistant. Answer using only the context below.' || chr(10) || chr(10) || 'Context:' || chr(10)
       || coalesce(b.lines, '') || chr(10) || 'Question: query ' || a.qid || chr(10) || 'Answer:' AS prompt
FROM asked a LEFT JOIN (SELECT qid, count(*) AS n, string_agg('- ' || text || chr(10), '' ORDER BY rank_no) AS lines FROM kept GROUP BY qid) b ON a.qid = b.qid
"""


@query("prompt_budget", _BUDGET_SQL)
def prompt_budget(spark: SparkSession, d: str) -> DataFrame:
    """Prompts from the logged retrieved chunks of all queries."""
    whole = F.col("text").isNotNull() & F.col("rank_no").isNotNull() & F.col("qid").isNotNull()
    rows = table(spark, d, "retrieved").where(whole).groupBy("qid", "rank_no").agg(F.min("text").alias("text"))
    asked = rows.select("qid").distinct().withColumn("question", F.concat(F.lit("query "), F.col("qid").cast("string")))
    return rag.prompts(rows, asked, RagConfig().token_budget)


@query("doc_count", "SELECT count(DISTINCT doc_id) AS documents FROM chunks WHERE text IS NOT NULL")
def doc_count(spark: SparkSession, d: str) -> DataFrame:
    return rag.document_count(table(spark, d, "chunks").where(F.col("text").isNotNull()))


@query(
    "remove_doc",
    "SELECT DISTINCT doc_id, chunk_no FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM retrieved WHERE rank_no = 1 AND doc_id IS NOT NULL)",
)
def remove_doc(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "retrieved").where((F.col("rank_no") == 1) & F.col("doc_id").isNotNull())
    return rag.remove(table(spark, d, "chunks").where(F.col("doc_id").isNotNull()), gone).select("doc_id", "chunk_no").distinct()


_LATEST = f"""SELECT source AS doc_id, arg_max({_TOKENS.format("coalesce(text, '')")}, doc_id) AS t FROM documents WHERE source IS NOT NULL GROUP BY source"""


@query("reingest", chunk_sql(64, 16, _LATEST))
def reingest(spark: SparkSession, d: str) -> DataFrame:
    """Pages as versions of their source: the last one replaces the others."""
    docs = table(spark, d, "documents").select(F.col("source"), F.col("doc_id").alias("version"), "text")
    return T.chunks(rag.latest(docs, "version", "source"), ChunkConfig(64, 16))


# -- the operation log ------------------------------------------------------------------------------

DIM = 48
_OK = "coalesce(len(vec) = 48 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))), false)"
_OPS = f"""
WITH o AS (SELECT DISTINCT ON (ext_id, lsn) * FROM op_log WHERE ext_id IS NOT NULL AND lsn IS NOT NULL AND (op = 3 OR (op IN (1, 2) AND {_OK}))),
"""
FOLD_SQL = _OPS + """
f AS (SELECT ext_id, arg_max(op, lsn) FILTER (op IN (1, 3)) AS rop, arg_max(vec, lsn) FILTER (op IN (1, 2)) AS vec,
             arg_max(CASE WHEN op = 1 AND meta IS NULL THEN map() ELSE meta END, lsn) FILTER (op = 1 OR (op = 2 AND meta IS NOT NULL)) AS meta
      FROM o GROUP BY ext_id),
live AS (SELECT * FROM f WHERE rop = 1),
"""
_STATE_SQL = FOLD_SQL + """
shown AS (SELECT ext_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, meta FROM live)
SELECT ext_id, round(list_reduce(v, lambda s, x: s + x, 0.0), 6) AS vec_sum, round(v[1], 6) AS vec_first,
       CAST(cardinality(meta) AS INTEGER) AS meta_size, meta['lang'].s AS lang, meta['year'].i AS year FROM shown
"""


def _state_shown(state: DataFrame) -> DataFrame:
    total = F.aggregate(F.transform("vec", lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return state.select(
        "ext_id", F.round(total, 6).alias("vec_sum"), F.round(F.get("vec", 0).cast("double"), 6).alias("vec_first"),
        F.size("meta").alias("meta_size"), F.try_element_at("meta", F.lit("lang"))["s"].alias("lang"),
        F.try_element_at("meta", F.lit("year"))["i"].alias("year"),
    )


@query("oplog_state", _STATE_SQL)
def oplog_state(spark: SparkSession, d: str) -> DataFrame:
    return _state_shown(oplog.fold(table(spark, d, "op_log"), DIM))


_EFFECTS = """
e AS (SELECT lsn, op, ext_id,
             op = 1 OR coalesce(last_value(CASE WHEN op <> 2 THEN op END IGNORE NULLS)
               OVER (PARTITION BY ext_id ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS effective FROM o)
SELECT lsn, op, ext_id, effective FROM e
"""


@query("oplog_effects", _OPS + _EFFECTS)
def oplog_effects(spark: SparkSession, d: str) -> DataFrame:
    return oplog.effects(table(spark, d, "op_log"), DIM)


_SLOTS = """
k AS (SELECT ext_id, min(lsn) FILTER (op = 1) AS first_insert, arg_max(op, lsn) FILTER (op IN (1, 3)) AS rop FROM o GROUP BY ext_id),
n AS (SELECT ext_id, row_number() OVER (ORDER BY first_insert, ext_id) - 1 AS internal_id, rop = 1 AS live FROM k WHERE first_insert IS NOT NULL)
"""


@query("oplog_slots", _OPS + _SLOTS + "SELECT ext_id, internal_id, live FROM n")
def oplog_slots(spark: SparkSession, d: str) -> DataFrame:
    return oplog.slots(table(spark, d, "op_log"), DIM)


@query(
    "compact",
    _OPS + _SLOTS + "SELECT ext_id, row_number() OVER (ORDER BY internal_id) - 1 AS internal_id FROM n WHERE live",
)
def compact(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "op_log")
    return oplog.compact(oplog.fold(ops, DIM), oplog.slots(ops, DIM)).select("ext_id", "internal_id")


@query("snapshot_tail_equiv", _STATE_SQL)
def snapshot_tail_equiv(spark: SparkSession, d: str) -> DataFrame:
    """State from a snapshot at the middle of the log and the operations after it."""
    ops = table(spark, d, "op_log")
    bounds = ops.agg(F.min("lsn"), F.max("lsn")).first()
    middle = ((bounds[0] or 0) + (bounds[1] or 0)) // 2
    snapshot = written(oplog.fold(ops.where(F.col("lsn") <= middle), DIM), "snapshot")
    return _state_shown(oplog.fold(oplog.with_snapshot(snapshot, middle, ops), DIM))


@query(
    "store_reads",
    FOLD_SQL + """
k AS (SELECT count(*) AS slots FROM (SELECT ext_id FROM o WHERE op = 1 GROUP BY ext_id))
SELECT (SELECT count(*) FROM live) AS size, k.slots AS slots, 48 AS dim FROM k
""",
)
def store_reads(spark: SparkSession, d: str) -> DataFrame:
    ops = table(spark, d, "op_log")
    size = oplog.fold(ops, DIM, with_meta=False).agg(F.count(F.lit(1)).alias("size"))
    slots = oplog.accepted(ops, DIM).where("op = 1").agg(F.countDistinct("ext_id").alias("slots"))
    return size.crossJoin(slots).withColumn("dim", F.lit(DIM))  # one row each


def _collection(spark: SparkSession, d: str, path: str | None = None, **options) -> Collection:
    return Collection(spark, CollectionConfig(DIM, persistence=Persistence(path) if path else None), **options)


def _accepted_ops(spark: SparkSession, d: str) -> DataFrame:
    """The operations that pass validation, repeated rows once."""
    ops = oplog.accepted(table(spark, d, "op_log"), DIM).dropDuplicates(["ext_id", "lsn"])
    return ops.select("lsn", F.col("op").cast("int").alias("op"), "ext_id", "vec", F.col("meta").cast(oplog.META).alias("meta"))


@query(
    "stats",
    FOLD_SQL + """
k AS (SELECT count(DISTINCT ext_id) AS slots FROM o WHERE op = 1)
SELECT 48 AS dim, 'cosine' AS metric, 'flat' AS index, (SELECT count(*) FROM live) AS size, k.slots AS slots FROM k
""",
)
def stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of a collection that has been given the whole log."""
    c = _collection(spark, d)
    c.apply_ops(_accepted_ops(spark, d))
    return c.stats()


@query("collection_effects", _OPS + _EFFECTS.replace("SELECT lsn, op, ext_id, effective FROM e", "SELECT ext_id, op, effective, count(*) AS n FROM e GROUP BY ALL"))
def collection_effects(spark: SparkSession, d: str) -> DataFrame:
    """What applying the log to a collection says of each operation, counted."""
    told = _collection(spark, d).apply_ops(_accepted_ops(spark, d))
    return told.groupBy("ext_id", "op", "effective").agg(F.count(F.lit(1)).alias("n"))


@query("recover_snapshot_tail", _STATE_SQL)
def recover_snapshot_tail(spark: SparkSession, d: str) -> DataFrame:
    """A durable collection: half of the log, a snapshot, the other half, and opened again."""
    path = f"{shared_dir(spark)}/quillvec/collection-{uuid.uuid4().hex}"
    ops = written(_accepted_ops(spark, d), "ops")
    middle = ops.agg(F.expr("percentile_approx(lsn, 0.5)")).first()[0] or 0
    c = _collection(spark, d, path)
    c.apply_ops(ops.where(F.col("lsn") <= middle))
    c.snapshot()
    c.apply_ops(ops.where(F.col("lsn") > middle))
    c.close()
    return _state_shown(_collection(spark, d, path).state())


@query(
    "collection_search",
    FOLD_SQL + f"""
q0 AS (SELECT qid, min(qv) AS qv FROM queries WHERE qid % 50 = 0 AND coalesce(len(qv) = 48 AND list_bool_and(list_transform(qv, lambda x: x IS NOT NULL AND isfinite(x))), false) GROUP BY qid),
q AS (SELECT qid, qv, {_NORM.format('qv')} AS nq FROM (SELECT qid, list_transform(qv, lambda x: CAST(x AS DOUBLE)) AS qv FROM q0)),
r AS (SELECT ext_id, v, {_NORM.format('v')} AS nv FROM (SELECT ext_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM live
      WHERE {_YEAR.format(">= 1880")} AND NOT {_YEAR.format(">= 1900")})),
s AS (SELECT qid, ext_id, {_SCORE_SQL['cosine']} AS score FROM r CROSS JOIN q),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, ext_id) AS rank_no FROM s)
SELECT qid, CAST(rank_no AS INTEGER) AS rank_no, ext_id, round(score, 6) AS score FROM t WHERE rank_no <= 10
""",
)
def collection_search(spark: SparkSession, d: str) -> DataFrame:
    """Batch search of a durable collection with a snapshot, by a filter on promoted metadata."""
    path = f"{shared_dir(spark)}/quillvec/collection-{uuid.uuid4().hex}"
    c = _collection(spark, d, path, promoted={"year": "year"})
    c.apply_ops(_accepted_ops(spark, d))
    c.snapshot()
    asked = search.clean_queries(table(spark, d, "queries").where(F.col("qid") % 50 == 0), DIM)
    return _shown(c.search_batch(asked, K, all_of(ge("year", 1880), negate(ge("year", 1900)))))


@query("rag_lifecycle", f"SELECT doc_id, chunk_no, text FROM ({chunk_sql(64, 16, _LATEST)}) WHERE doc_id <> (SELECT min(source) FROM documents)")
def rag_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """An engine that is given the first page of each source, then the last in its place, and loses one source."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("version"), "text")
    e = RagEngine(spark)
    e.ingest_all(rag.latest(docs.withColumn("version", -F.col("version")), "version", "source"))
    e.ingest_all(rag.latest(docs, "version", "source"))
    least = docs.agg(F.min("source")).first()[0]
    if least is not None:
        e.remove(least)
    return e.chunks().select("doc_id", "chunk_no", "text")


@query(
    "resolve_hits",
    _OPS + _SLOTS + """
SELECT h.qid, h.rank_no, h.ext_id, n.internal_id FROM (SELECT DISTINCT qid, rank_no, ext_id FROM hits) h LEFT JOIN n ON h.ext_id = n.ext_id AND n.live
""",
)
def resolve_hits(spark: SparkSession, d: str) -> DataFrame:
    """Current slot of every logged hit; null where its id is no longer live."""
    live = oplog.slots(table(spark, d, "op_log"), DIM).where("live").select("ext_id", "internal_id")
    return table(spark, d, "hits").select("qid", "rank_no", "ext_id").distinct().join(live, "ext_id", "left")


@query(
    "search_live",
    FOLD_SQL + f"""
q0 AS (SELECT qid, min(qv) AS qv FROM queries WHERE qid % 50 = 0 AND coalesce(len(qv) = 48 AND list_bool_and(list_transform(qv, lambda x: x IS NOT NULL AND isfinite(x))), false) GROUP BY qid),
q AS (SELECT qid, qv, {_NORM.format('qv')} AS nq FROM (SELECT qid, list_transform(qv, lambda x: CAST(x AS DOUBLE)) AS qv FROM q0)),
r AS (SELECT ext_id, v, {_NORM.format('v')} AS nv FROM (SELECT ext_id, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM live
      WHERE coalesce(CASE WHEN meta['lang'].t = 2 THEN meta['lang'].s = 'en' END, false))),
s AS (SELECT qid, ext_id, {_SCORE_SQL['cosine']} AS score FROM r CROSS JOIN q),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, ext_id) AS rank_no FROM s)
SELECT qid, CAST(rank_no AS INTEGER) AS rank_no, ext_id, round(score, 6) AS score FROM t WHERE rank_no <= 10
""",
)
def search_live(spark: SparkSession, d: str) -> DataFrame:
    """Filtered batch search over the folded log, for the queries whose id is divisible by 50."""
    state = filters.where(oplog.fold(table(spark, d, "op_log"), DIM), eq("lang", "en"))
    asked = search.clean_queries(table(spark, d, "queries").where(F.col("qid") % 50 == 0), DIM)
    return _shown(search.knn(state, asked, K, Metric.COSINE))


# -- formats, streaming, evaluation -----------------------------------------------------------------


@query("codec_roundtrip", "SELECT DISTINCT lsn, true AS same FROM op_log WHERE ext_id IS NOT NULL AND lsn IS NOT NULL")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every operation through bytes and back."""
    ops = table(spark, d, "op_log").where("ext_id is not null and lsn is not null").dropDuplicates(["lsn"])
    data = ops.select("lsn", "op", "ext_id", "vec", "meta", codec.encode_op(F.col("op"), F.col("ext_id"), F.col("vec"), F.col("meta")).alias("b"))
    back = data.withColumn("r", codec.decode_op(F.col("b")))
    entries = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.to_json(e)))
    vec = F.when(F.col("op") != 3, F.coalesce("vec", F.array().cast("array<float>")))
    meta = F.when(F.col("op") != 3, F.col("meta"))
    same = (
        F.col("r.op").eqNullSafe(F.col("op")) & F.col("r.ext_id").eqNullSafe(F.col("ext_id"))
        & F.col("r.vec").eqNullSafe(vec) & entries(F.col("r.meta")).eqNullSafe(entries(meta))
    )
    return back.select("lsn", same.alias("same"))


_CRC = (
    "xor(4294967295, list_reduce(list_transform(range(1, octet_length(encode(p)) + 1), lambda i: "
    "CAST('0x' || substr(hex(encode(p)), 2 * i - 1, 2) AS BIGINT)), lambda c, b: "
    "list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END, xor(c, b)), "
    "CAST(4294967295 AS BIGINT)))"
)


@query("crc", f"SELECT event_id, {_CRC} AS crc FROM (SELECT event_id, coalesce(props, '') AS p FROM events)")
def crc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.crc32(F.coalesce("props", F.lit(""))).alias("crc"))


@query("stream_fold", _STATE_SQL)
def stream_fold(spark: SparkSession, d: str) -> DataFrame:
    """The fold as a streaming aggregation over the log, in a few micro-batches."""
    from quillvec.streaming import fold

    place = f"{shared_dir(spark)}/quillvec/stream-{uuid.uuid4().hex}"
    ops = table(spark, d, "op_log").select("lsn", F.col("op").cast("int").alias("op"), "ext_id", "vec", F.col("meta").cast(oplog.META).alias("meta"))
    ops.repartition(4).write.parquet(f"{place}/ops")
    changes = fold.fold_stream(fold.read_ops(spark, f"{place}/ops", 2), DIM)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{place}/changes/b={number}")

    running = (
        changes.writeStream.outputMode("update").foreachBatch(save)
        .option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    empty = spark.createDataFrame([], f"ext_id string, live boolean, vec array<float>, meta {oplog.META}, batch int, b int")
    try:
        saved = spark.read.option("recursiveFileLookup", "false").parquet(f"{place}/changes")
    except Exception:  # no micro-batch: an empty log
        saved = empty
    last = saved.groupBy("ext_id").agg(F.max_by(F.struct("live", "vec", "meta"), "batch").alias("s"))
    return _state_shown(last.where("s.live").select("ext_id", "s.vec", "s.meta"))


@query(
    "percentile_lower",
    """
WITH s AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL)
SELECT p, v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1] AS value FROM s, (SELECT unnest([0.0::DOUBLE, 0.5, 0.95, 1.0]) AS p)
""",
)
def percentile_lower(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.percentile_lower(table(spark, d, "events"), "value", [0.0, 0.5, 0.95, 1.0])


@query(
    "logged_recall",
    """
WITH h AS (SELECT DISTINCT qid, rank_no, ext_id FROM hits WHERE qid IS NOT NULL AND rank_no IS NOT NULL AND ext_id IS NOT NULL),
top AS (SELECT DISTINCT qid, ext_id FROM h WHERE rank_no <= 5), truth AS (SELECT DISTINCT qid, ext_id FROM h WHERE rank_no <= 10)
SELECT round(avg(n / 10.0), 6) AS recall FROM (
  SELECT t.qid, count(p.ext_id) AS n FROM truth t LEFT JOIN top p ON t.qid = p.qid AND t.ext_id = p.ext_id GROUP BY t.qid)
""",
)
def logged_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of the first five logged hits, as a check of the measure."""
    hits = table(spark, d, "hits").select("qid", "rank_no", "ext_id").dropna().distinct()
    truth = hits.where("rank_no <= 10").select("qid", "ext_id").distinct()
    return evaluation.recall_at_k(hits.where("rank_no <= 5"), truth, 10).select(F.round("recall", 6).alias("recall"))
