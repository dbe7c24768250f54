"""Queries of the training-data problems, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillvec.llm import abuse, bpe, clusters, neardup, neighbours, packing, split, subset
from quillvec.llm.vectors import DIM, live_units
from quillvec.plans.catalogue import FOLD_SQL
from quillvec.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized_paragraphs(table(spark, d, "documents"), table(spark, d, "chunk_config"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(table(spark, d, "documents"), table(spark, d, "chunk_config"))


def p2_subset(spark: SparkSession, d: str) -> DataFrame:
    return subset.requested(*(table(spark, d, t) for t in ("op_log", "retrieved", "subset_request")))


def p2_retrieved(spark: SparkSession, d: str) -> DataFrame:
    sizes = subset.sizes_of(table(spark, d, "subset_request"), "retrieved")
    return subset.per_query(table(spark, d, "retrieved"), sizes)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.anchored(table(spark, d, "op_log"), table(spark, d, "anchors"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(table(spark, d, "op_log"), table(spark, d, "anchors"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return clusters.memberships(table(spark, d, "op_log"), table(spark, d, "anchors"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_copies(neardup.corpus(table(spark, d, "documents"), table(spark, d, "chunks")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(neardup.corpus(table(spark, d, "documents"), table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.mutual_pairs(table(spark, d, "op_log"))


def p5_similar(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar records; queries are the records whose id hashes to a multiple of 50."""
    asks = F.crc32("ext_id") % 50 == 0
    return neighbours.most_similar(live_units(table(spark, d, "op_log")), queries=asks, **neighbours.THOROUGH)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "pack_config"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    config = table(spark, d, "pack_config")
    return packing.fill_report(packing.pack_texts(table(spark, d, "documents"), config), config)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("found").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scores(table(spark, d, "documents"), table(spark, d, "labels"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_subset": p2_subset,
    "p2_retrieved": p2_retrieved,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p3_members": p3_members,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_similar": p5_similar,
    "p6_ids": p6_ids,
    "p7_pack": p7_pack,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

_SUM = "[" + ", ".join(f"sum(u[{i}])" for i in range(1, DIM + 1)) + "]"


def _shift_sql(name: str, before: str, reach: float) -> str:
    """Per anchor, the mean direction of the live records within ``reach`` of the direction before."""
    return f"""{name} AS (SELECT anchor_id, au, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS m, n
  FROM (SELECT anchor_id, any_value(au) AS au, {_SUM} AS s, count(*) AS n FROM {before} JOIN u ON list_dot_product(m, u) >= {reach} GROUP BY anchor_id))"""


_UNIT = "list_transform({0}, lambda x: CAST(x AS DOUBLE))"
_LIVE_UNITS = FOLD_SQL + f"""
w AS (SELECT ext_id, {_UNIT.format('vec')} AS v FROM live),
u AS (SELECT ext_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM w WHERE list_dot_product(v, v) > 0),
"""

_NEAR = """t AS (
  SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS key, text FROM documents UNION ALL
  SELECT 'chunk', doc_id || '#' || chunk_no, min(text) FROM chunks GROUP BY ALL),
n AS (SELECT kind, key, trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[ \t\n\v\f\r]+', ' ', 'g')) AS text FROM t WHERE key IS NOT NULL),
-- Texts of which some are equal to others are told apart by their ids; shingles once per text.
d AS (SELECT kind, text, dense_rank() OVER (ORDER BY kind, text) AS id, key FROM n WHERE length(text) >= 200),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, length(text) - 6), lambda i: hash(substr(text, i, 8)))) AS h
      FROM (SELECT DISTINCT kind, id, text FROM d)),
z AS (SELECT id, count(*) AS z FROM s GROUP BY id),
-- Shingles by how many texts hold them, rarest first: a pair shares one of each text's first half and one.
f AS (SELECT kind, h, count(*) AS f FROM s GROUP BY kind, h),
o AS (SELECT s.kind, s.id, s.h, row_number() OVER (PARTITION BY s.id ORDER BY f.f, s.h) AS n FROM s JOIN f ON s.kind = f.kind AND s.h = f.h),
p AS (SELECT o.kind, o.id, o.h FROM o JOIN z ON o.id = z.id WHERE o.n <= z.z - ceil(z.z / 2.0) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.kind = b.kind AND a.h = b.h AND a.id < b.id),
v AS (SELECT c.a, c.b, count(*) AS shared FROM c JOIN s x ON x.id = c.a JOIN s y ON y.id = c.b AND x.h = y.h GROUP BY c.a, c.b),
l AS (SELECT v.a, v.b FROM v JOIN z x ON x.id = v.a JOIN z y ON y.id = v.b WHERE 3 * shared >= x.z + y.z
      UNION ALL SELECT DISTINCT id, id FROM d)
"""
_PAIRS = """SELECT DISTINCT x.kind, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b
FROM l JOIN d x ON x.id = l.a JOIN d y ON y.id = l.b WHERE x.key <> y.key
"""

SQL: dict[str, str] = {
    # A mean shift from every anchor: first wide, then within the reach until it stands still.
    "p3_found": _LIVE_UNITS + f"""
g AS (SELECT anchor_id, {_UNIT.format('vec')} AS v FROM anchors WHERE anchor_id IS NOT NULL
      AND coalesce(len(vec) = {DIM} AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND isfinite(x))), false)),
m0 AS (SELECT anchor_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS au, au AS m FROM g WHERE list_dot_product(v, v) > 0),
{", ".join(_shift_sql(f"m{i + 1}", f"m{i}", 0.5 if i == 0 else clusters.REACH) for i in range(6))}
SELECT DISTINCT anchor_id, ext_id FROM m6 JOIN u ON list_dot_product(m, u) >= {clusters.REACH}
WHERE n >= 10 AND list_dot_product(m, au) >= {clusters.REACH}
""",
    "p5_found": _LIVE_UNITS + """
p AS (SELECT a.ext_id AS x, b.ext_id AS y, list_dot_product(a.u, b.u) AS c FROM u a JOIN u b ON a.ext_id <> b.ext_id
      AND list_dot_product(a.u, b.u) >= 0.96 - 1e-6),
r AS (SELECT x, y FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY round(c, 6) DESC, y) AS n FROM p) WHERE n <= 10)
SELECT r.x AS ext_a, r.y AS ext_b FROM r JOIN r s ON r.x = s.y AND r.y = s.x WHERE r.x < r.y
""",
    "p4_found": f"WITH {_NEAR}{_PAIRS}",
    "p4_groups": f"""
WITH RECURSIVE {_NEAR},
pairs AS ({_PAIRS}),
e AS (SELECT kind, key_a AS x, key_b AS y FROM pairs UNION ALL SELECT kind, key_b, key_a FROM pairs),
r AS (SELECT kind, x, y FROM e UNION SELECT r.kind, r.x, e.y FROM r JOIN e ON r.kind = e.kind AND r.y = e.x),
g AS (SELECT kind, x AS key, min(y) AS group_key, count(*) AS group_size FROM r GROUP BY kind, x),
n2 AS (SELECT kind, x AS key, count(*) AS links FROM e GROUP BY kind, x)
SELECT d.kind, d.key, coalesce(g.group_key, d.key) AS group_key, coalesce(g.group_size, 1) AS group_size, coalesce(n2.links, 0) AS links
FROM d LEFT JOIN g ON d.kind = g.kind AND d.key = g.key LEFT JOIN n2 ON d.kind = n2.kind AND d.key = n2.key
""",
    "p1_found": r"""
WITH lines AS (
  SELECT doc_id, source, pos,
         len(list_filter(regexp_split_to_array(line, '[ \t\v\f\r]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
opened AS (
  SELECT *, CASE WHEN n > 0 AND coalesce(lag(n) OVER (PARTITION BY doc_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS o
  FROM lines),
numbered AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS para_no FROM opened),
paras AS (
  SELECT doc_id, any_value(source) AS source, para_no, sum(n) AS tokens
  FROM numbered WHERE n > 0 GROUP BY doc_id, para_no),
own AS (SELECT source, arg_min(window_size, config_id) AS w FROM chunk_config GROUP BY source)
SELECT p.doc_id, CAST(p.para_no AS INTEGER) AS para_no
FROM paras p LEFT JOIN own c ON p.source = c.source
WHERE p.tokens > greatest(1, coalesce(c.w, (SELECT w FROM own WHERE source = '*')))
""",
    "p2_retrieved": r"""
WITH distinct_rows AS (SELECT DISTINCT qid, rank_no, doc_id, text FROM retrieved),
r AS (SELECT *, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[ \t\n\v\f\r]+', ' ', 'g')) AS norm
      FROM distinct_rows),
c AS (SELECT *, least(row_number() OVER (PARTITION BY qid, norm ORDER BY rank_no NULLS LAST, doc_id NULLS LAST, text NULLS LAST), 2) AS copy FROM r),
w AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY copy, rank_no NULLS LAST, text NULLS LAST) AS turn FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY copy, turn, rank_no NULLS LAST, doc_id NULLS LAST, text NULLS LAST) AS place FROM w),
s AS (SELECT request_id, subset_size FROM subset_request WHERE scope = 'retrieved')
SELECT s.request_id, p.qid, p.rank_no, p.doc_id, CAST(p.place AS INTEGER) AS place
FROM p JOIN s ON p.place <= s.subset_size
""",
}
