"""Log fold, search, cells, retrieval, evaluation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.config import AnnParams, ChunkConfig, Metric
from quillvec.functions import filters as f
from quillvec.operators import ann, evaluation, oplog, rag, search
from quillvec.sources.store import OPS


def simulate(ops):
    """One operation after another."""
    live, effects, slots = {}, {}, {}
    for lsn, op, key, vec, meta in sorted({o[0]: o for o in ops}.values(), key=lambda o: o[0]):
        if op == 1:
            slots.setdefault(key, len(slots))
            live[key] = (vec, meta or {})
            effects[lsn] = True
        elif key in live and op == 2:
            live[key] = (vec, live[key][1] if meta is None else meta)
            effects[lsn] = True
        elif key in live and op == 3:
            del live[key]
            effects[lsn] = True
        else:
            effects[lsn] = False
    return live, effects, slots


@pytest.fixture(scope="module")
def ops():
    r = random.Random(4)
    rows = []
    for lsn in range(1, 1500):
        op = r.choice([1, 2, 2, 3])
        key = "hot" if r.random() < 0.3 else f"k{r.randrange(60)}"
        meta = r.choice([None, {}, f.meta_map({"n": r.randrange(5)})]) if op != 3 else None
        rows.append((lsn, op, key, None if op == 3 else [float(lsn), 1.0], meta))
    rows += r.sample(rows, 100)
    r.shuffle(rows)
    return rows


def plain(meta):
    return {k: v["i"] for k, v in meta.items()}


def test_fold_effects_and_slots_equal_the_simulation(spark, ops):
    df = spark.createDataFrame(ops, OPS)
    live, effects, slots = simulate(ops)
    got = {r.ext_id: (r.vec, plain(r.meta)) for r in oplog.fold(df, 2).collect()}
    assert got == {k: (v, plain(m)) for k, (v, m) in live.items()}
    assert {r.lsn: r.effective for r in oplog.effects(df, 2).collect()} == effects
    numbered = oplog.slots(df, 2).collect()
    assert {r.ext_id: r.internal_id for r in numbered} == slots
    assert {r.ext_id for r in numbered if r.live} == set(live)
    packed = {r.ext_id: r.internal_id for r in oplog.compact(oplog.fold(df, 2), oplog.slots(df, 2)).collect()}
    assert packed == {k: n for n, k in enumerate(sorted(live, key=slots.get))}


def test_snapshot_and_tail_equal_the_whole_log(spark, ops):
    df = spark.createDataFrame(ops, OPS)
    snapshot = oplog.fold(df.where("lsn <= 700"), 2)
    both = oplog.fold(oplog.with_snapshot(snapshot, 700, df), 2)
    show = lambda x: sorted((r.ext_id, r.vec, sorted(plain(r.meta).items())) for r in x.collect())
    assert show(both) == show(oplog.fold(df, 2))


def test_fold_rejects_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, "a", [1.0, 2.0], None), (2, 1, "a", [1.0], None), (3, 2, "a", [nan, 1.0], None), (4, 2, "a", [inf, 1.0], None),
        (5, 2, "a", None, None), (6, 7, "a", [5.0, 5.0], None), (None, 3, "a", None, None), (8, 1, None, [1.0, 1.0], None),
        (9, 1, "b", [None, 1.0], None), (10, 2, "c", [1.0, 1.0], None), (11, 1, "z", [0.0, 0.0], None),
    ]
    got = {r.ext_id: r.vec for r in oplog.fold(spark.createDataFrame(rows, OPS), 2).collect()}
    assert got == {"a": [1.0, 2.0], "z": [0.0, 0.0]}
    empty = spark.createDataFrame([], OPS)
    assert oplog.fold(empty, 2).count() == oplog.effects(empty, 2).count() == oplog.slots(empty, 2).count() == 0


def points(spark, x):
    return evaluation.vector_table(spark, np.asarray(x, np.float32))


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kernel", ["expr", "scan", "blocks"])
def test_search_equals_brute_force(spark, metric, kernel):
    x, q = evaluation.uniform_vectors(300, 8, 1), evaluation.uniform_vectors(7, 8, 2)
    rows = points(spark, x).withColumn("score", F.lit("clash"))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, qv array<float>")
    got = search.knn(rows, asked, 5, metric, kernel=kernel).collect()
    truth = evaluation  # noqa: F841
    from quillvec.functions.distance import matrix

    d = matrix(metric, q, x)
    for i in range(7):
        mine = sorted((r.rank_no, r.ext_id, r.score) for r in got if r.qid == i)
        best = np.argsort(d[i], kind="stable")[:5]
        assert [m[1] for m in mine] == [f"v{j}" for j in best]
        assert np.allclose([m[2] for m in mine], d[i][best])


@pytest.mark.parametrize("kernel", ["expr", "scan", "blocks"])
def test_search_edges(spark, kernel):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [5.0, 0.0])], "ext_id string, vec array<float>")
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "qid int, qv array<float>")
    run = lambda k: [(r.rank_no, r.ext_id) for r in search.knn(rows, asked, k, "l2", kernel=kernel).orderBy("rank_no").collect()]
    assert run(0) == [] and run(2) == [(1, "a"), (2, "b")] and run(9) == [(1, "a"), (2, "b"), (3, "d")]
    assert search.knn(rows.limit(0), asked, 3, "l2", kernel=kernel).count() == 0
    assert search.knn(rows, asked.limit(0), 3, "l2", kernel=kernel).count() == 0


def test_clean_queries(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0]), (None, [1.0, 1.0]), (4, [float("nan"), 0.0])]
    asked = spark.createDataFrame(rows, "qid int, qv array<float>")
    assert [r.qid for r in search.clean_queries(asked, 2).collect()] == [1]


def test_ann_recall_contract(spark):
    x, q = evaluation.uniform_vectors(2000, 16, 123), evaluation.uniform_vectors(100, 16, 124)
    rows = points(spark, x).withColumn("even", F.substring("ext_id", 2, 9).cast("int") % 2 == 0)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid int, qv array<float>")
    index = ann.build(rows, Metric.L2, AnnParams())
    truth = search.knn(rows, asked, 10, "l2", kernel="blocks")
    found = ann.search(index, asked, 10, ef=200).cache()
    assert evaluation.recall_at_k(found, truth, 10).first().recall >= 0.9
    few = asked.where("qid < 5")
    show = lambda df: [(r.qid, r.rank_no, r.ext_id) for r in df.orderBy("qid", "rank_no").collect()]
    assert show(ann.search(index, few, 10, all_cells=True)) == show(truth.where("qid < 5"))
    assert show(ann.search(index, few, 10, ef=200)) == show(found.where("qid < 5"))
    for r in ann.search(index, few, 10, F.col("even")).collect():
        assert int(r.ext_id[1:]) % 2 == 0
    assert ann.search(index, few, 0).count() == 0
    assert ann.search(index, few.limit(1), 5000).count() == 2000
    assert index.stats().agg(F.sum("size")).first()[0] == 2000


@pytest.mark.parametrize("metric", [Metric.L2, Metric.COSINE])
def test_ann_recall_does_not_fall_as_the_table_grows(spark, metric):
    x = np.random.default_rng(3).normal(size=(6000, 48)).astype(np.float32)
    rows = evaluation.vector_table(spark, x).withColumn("kept", F.crc32("ext_id") % 5 == 0).cache()
    asked = evaluation.vector_table(spark, np.random.default_rng(4).normal(size=(100, 48)).astype(np.float32))
    asked = asked.select(F.substring("ext_id", 2, 9).cast("long").alias("qid"), F.col("vec").alias("qv")).cache()
    index = ann.build(rows, metric, AnnParams(ef=100))
    for allowed in (F.lit(True), F.col("kept")):
        truth = search.knn(rows.where(allowed), asked, 10, metric)
        assert evaluation.recall_at_k(ann.search(index, asked, 10, allowed), truth, 10).first().recall >= 0.9


def test_ann_probes_few_cells_of_clustered_rows(spark):
    index = ann.build(evaluation.vector_table(spark, evaluation.clustered_vectors(3000, 32, 50)), Metric.L2)
    assert index.share(10, 3000) < 0.2


def test_ann_on_an_empty_and_a_single_row(spark):
    rows = points(spark, [[1.0, 2.0]])
    asked = spark.createDataFrame([(1, [0.0, 0.0])], "qid int, qv array<float>")
    assert [r.ext_id for r in ann.search(ann.build(rows), asked, 3).collect()] == ["v0"]
    assert ann.search(ann.build(rows.limit(0)), asked, 3).count() == 0


DOCS = [
    ("d1", "mitochondria are the powerhouse of the cell"),
    ("d2", "vector databases index embeddings for nearest neighbour search"),
    ("d3", "the quick brown fox jumps over the lazy dog"),
]


def test_retrieval_and_prompts(spark):
    docs = spark.createDataFrame([*DOCS, ("e", ""), ("n", None)], "doc_id string, text string")
    model = rag.default_model()
    chunks = rag.ingest(docs, model, ChunkConfig(4, 1)).cache()
    assert rag.document_count(chunks).first().documents == 3
    asked = spark.createDataFrame([(1, "nearest neighbour vector search"), (2, "zz")], "qid int, question string")
    hits = rag.retrieve(chunks, asked, model, 3)
    assert hits.where("qid = 1 and rank_no = 1").first().doc_id == "d2"
    made = {r.qid: r for r in rag.prompts(hits, asked, 512).collect()}
    assert made[1].bullets == 3 and made[1].prompt.endswith("Question: nearest neighbour vector search\nAnswer:")
    none = rag.prompts(hits.limit(0), asked, 512).collect()
    assert [r.bullets for r in none] == [0, 0]


def test_budget_worked_example(spark):
    rows = [(1, i, "a b c d e") for i in range(1, 11)]
    hits = spark.createDataFrame(rows, "qid int, rank_no int, text string")
    asked = spark.createDataFrame([(1, "q")], "qid int, question string")
    count = lambda b: rag.prompts(hits, asked, b).first().bullets
    assert count(40) == 3 and count(512) == 10 and count(0) == 0


def test_latest_remove_and_reingest(spark):
    versions = spark.createDataFrame([("a", 1, "x y"), ("a", 2, None), ("b", 1, "z")], "doc_id string, v int, text string")
    assert {r.doc_id: r.text for r in rag.latest(versions, "v").collect()} == {"a": None, "b": "z"}
    model = rag.default_model()
    old = rag.ingest(spark.createDataFrame([("a", "one two three four"), ("b", "z")], "doc_id string, text string"), model, ChunkConfig(2, 0))
    new = rag.reingest(old, spark.createDataFrame([("a", "five")], "doc_id string, text string"), model, ChunkConfig(2, 0))
    assert sorted(r.ext_id for r in new.collect()) == ["a#0", "b#0"]
    assert rag.remove(old, spark.createDataFrame([("q",)], "doc_id string")).count() == 3


def test_percentile_lower(spark):
    values = [5.0, 1.0, 1.0, 9.0, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r.p: r.value for r in evaluation.percentile_lower(df, "x", [0, 0.5, 0.95, 1]).collect()}
    known = sorted(v for v in values if v is not None)
    assert got == {p: known[int(p * 4)] for p in (0, 0.5, 0.95, 1)}
    assert evaluation.percentile_lower(df.limit(0), "x", [0.5]).count() == 0


def test_sweep_and_data(spark):
    x = evaluation.clustered_vectors(60, 4, clusters=3)
    rows = points(spark, x)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "qid int, qv array<float>")
    truth = search.knn(rows, asked, 5, "l2")
    out = evaluation.sweep([5], lambda k: search.knn(rows, asked, k, "l2"), truth, 5)
    assert out[0]["recall"] == 1.0
