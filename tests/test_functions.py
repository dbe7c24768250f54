"""Distances, filters, tokens, hashes, chunks, codec."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.config import ChunkConfig, CollectionConfig, Metric
from quillvec.functions import codec, distance as D, filters as f, text as T
from quillvec.operators import embed


def one(spark, metric, a, b):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(D.distance(metric, F.col("a"), F.col("b"))).first()[0]


@pytest.mark.parametrize(
    "metric, a, b, expected",
    [
        ("l2", [1, 2, 3], [4, 6, 3], 25), ("l2", [1, 2], [1, 2], 0), ("cosine", [1, 0], [3, 0], 0), ("cosine", [1, 0], [0, 2], 1),
        ("cosine", [1, 0], [-1, 0], 2), ("cosine", [0, 0], [1, 0], 1), ("dot", [1, 2, 3], [1, 1, 1], -6), ("dot", [], [], 0),
    ],
)
def test_distance(spark, metric, a, b, expected):
    a, b = [float(x) for x in a], [float(x) for x in b]
    assert one(spark, metric, a, b) == pytest.approx(expected, abs=1e-5)
    assert one(spark, metric, b, a) == pytest.approx(expected, abs=1e-5)
    assert D.matrix(metric, np.array([a]), np.array([b]))[0, 0] == pytest.approx(expected, abs=1e-5)


def test_distance_edges(spark):
    assert one(spark, "l2", None, [1.0]) is None
    with pytest.raises(Exception, match="differ in size"):
        one(spark, "l2", [1.0], [1.0, 2.0])
    v = [0.1, 0.2, 0.3]
    assert one(spark, "cosine", v, v) >= 0


def test_dim_must_be_positive():
    with pytest.raises(ValueError):
        CollectionConfig(0)


ROWS = [
    ("a", {"lang": "en", "year": 2020, "ok": True}),
    ("b", {"lang": "fr", "year": 2021.5}),
    ("c", {}),
    ("d", None),
    ("e", {"lang": 7, "year": "2020", "ok": False, "nested": {"x": 1}}),
]


@pytest.fixture(scope="module")
def meta(spark):
    from quillvec.operators.oplog import META

    return spark.createDataFrame([(i, None if m is None else f.meta_map(m)) for i, m in ROWS], f"id string, meta {META}").cache()


@pytest.mark.parametrize(
    "tree, expected",
    [
        (f.eq("lang", "en"), "a"), (f.ne("lang", "en"), "b"), (f.negate(f.eq("lang", "en")), "bcde"), (f.eq("author", "x"), ""),
        (f.negate(f.eq("author", "x")), "abcde"), (f.ge("year", 2020), "ab"), (f.gt("year", 2020), "b"), (f.lt("year", 2021.0), "a"),
        (f.le("year", 2021.5), "ab"), (f.eq("ok", True), "a"), (f.eq("ok", 1), ""), (f.lt("ok", True), "e"), (f.eq("lang", 7), "e"),
        (f.is_in("lang", ["en", 7]), "ae"), (f.is_in("lang", []), ""), (f.all_of(), "abcde"), (f.any_of(), ""),
        (f.all_of(f.eq("lang", "en"), f.eq("ok", True)), "a"), (f.any_of(f.eq("lang", "fr"), f.eq("ok", False)), "be"),
        (f.all_of(f.any_of(f.eq("lang", "en"), f.eq("lang", "fr")), f.negate(f.gt("year", 2021))), "a"), (f.gt("lang", "e"), "ab"),
        (f.eq("nested", '{"x":1}'), "e"), (f.from_json({"lang": "fr"}), "b"), (f.from_json([]), "abcde"), (f.from_json({}), "abcde"),
    ],
)
def test_filters(meta, tree, expected):
    assert sorted(r["id"] for r in f.where(meta, tree).collect()) == sorted(expected)
    assert sorted(r["id"] for r in meta.where(f.Compiler(meta).column(tree)).collect()) == sorted(expected)
    assert sorted(r["id"] for r in f.where(meta, f.negate(tree)).collect()) == sorted(set("abcde") - set(expected))


def test_filter_on_promoted_column_is_pushed_down(spark, tmp_path):
    spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, label int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = f.where(df, f.eq("label", 2), promoted={"label": "label"})
    assert kept.count() == 3
    assert "EqualTo(label,2)" in kept._jdf.queryExecution().executedPlan().toString().replace(" ", "")
    assert f.where(df, f.eq("label", "2"), promoted={"label": "label"}).count() == 0


def test_tokens_keep_other_letters_and_spaces(spark):
    df = spark.createDataFrame([("  A É b\tC\x0bd ",), ("",), (None,), (" \n ",)], "t string")
    rows = [(r[0], r[1]) for r in df.select(T.tokens(F.col("t")), T.token_count(F.col("t"))).collect()]
    assert rows == [(["a", "É b", "c", "d"], 4), ([], 0), (None, 0), ([], 0)]


def cut(words, window, overlap):
    window, overlap = ChunkConfig(window, overlap).effective
    out, at = [], 0
    while words:
        out.append((at, min(len(words), at + window)))
        if at + window >= len(words):
            break
        at += window - overlap
    return out


@pytest.mark.parametrize("window, overlap", [(4, 2), (2, 5), (0, 0), (64, 16), (10, 0), (3, 2)])
def test_chunks(spark, window, overlap):
    texts = [" ".join(f"T{i}" for i in range(n)) for n in (0, 1, 4, 5, 10, 11)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.chunk_no, r.start_token, r.end_token, r.text) for r in T.chunks(df, ChunkConfig(window, overlap)).collect())
    want = []
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        want += [(i, n, a, b, " ".join(words[a:b])) for n, (a, b) in enumerate(cut(words, window, overlap))]
    assert got == want


def test_hash_halves_equal_the_integer_hash(spark):
    words = ["", "a", "abc", "Straße", "日本語", "x" * 300]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.fnv_halves(F.col("w")).alias("h"))
    for r in rows.select("w", "h", T.fnv_bucket(F.col("h"), 100).alias("b"), T.fnv_sign(F.col("h")).alias("s")).collect():
        h = T.FNV_BASIS
        for b in r.w.encode():
            h = (h ^ b) * T.FNV_PRIME % 2**64
        assert (r.h.hi * 2**32 + r.h.lo, r.b, r.s) == (h, h % 100, 1 if h >> 63 else -1)


def test_embedding_is_unit_deterministic_and_equal_to_sparse(spark):
    df = spark.createDataFrame([(0, "vector databases store vectors"), (1, "a b"), (2, None), (3, "")], "k int, text string")
    model = embed.HashingModel(100)
    dense = {r.k: np.array(r.v) for r in df.select("k", model.column(F.col("text")).alias("v")).collect()}
    assert np.linalg.norm(dense[0]) == pytest.approx(1, abs=1e-6)
    assert all(not dense[k].any() for k in (1, 2, 3))
    other = np.zeros(100)
    for r in embed.embed_sparse(df, ["k"], dim=100).collect():
        assert r.k == 0
        other[r.idx] = r.weight
    assert np.allclose(other, dense[0], atol=1e-6)


def test_function_model(spark):
    model = embed.FunctionModel(2, lambda texts: np.array([[len(t), 1.0] for t in texts]))
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(model.column(F.col("t"))).collect()] == [[3.0, 1.0], [0.0, 1.0]]


META = {"lang": f.meta_value("en"), "year": f.meta_value(2**60 + 1), "score": f.meta_value(0.25), "ok": f.meta_value(True)}


def test_codec_layout_and_errors():
    data = codec.encode(1, "doc-42", [1.5, -2, 3.25], META)
    assert data[:11] == b"\x01\x06\x00\x00\x00doc-42"
    back = codec.decode(data)
    assert back == {"op": 1, "ext_id": "doc-42", "vec": [1.5, -2.0, 3.25], "meta": META}
    assert codec.decode(codec.encode(2, "x", [1.0], None))["meta"] is None
    assert codec.decode(codec.encode(2, "x", [1.0], {}))["meta"] == {}
    assert codec.decode(codec.encode(3, "x", None, None)) == {"op": 3, "ext_id": "x", "vec": None, "meta": None}
    for n in range(len(data)):
        with pytest.raises(codec.CorruptRecord):
            codec.decode(data[:n])
    with pytest.raises(codec.CorruptRecord):
        codec.decode(b"\x09" + data[1:])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=6), st.integers(0, 400))
def test_frames_stop_at_a_torn_tail(payloads, cut_at):
    whole = b"".join(map(codec.frame, payloads))
    got = list(codec.frames(whole[:cut_at]))
    assert got == payloads[: len(got)]
    assert list(codec.frames(whole)) == payloads


def test_frames_stop_at_a_flipped_byte():
    whole = bytearray(b"".join(codec.frame(p) for p in (b"alpha", b"beta", b"gamma")))
    whole[8 + 5 + 8] ^= 1
    assert list(codec.frames(bytes(whole))) == [b"alpha"]


def test_codec_columns(spark):
    from quillvec.operators.oplog import META as KIND

    df = spark.createDataFrame([(1, "a", [1.0], META), (3, "b", None, None), (None, "c", None, None)], f"op int, e string, v array<float>, m {KIND}")
    data = df.select("e", codec.encode_op(F.col("op"), F.col("e"), F.col("v"), F.col("m")).alias("b"))
    rows = {r.e: r.d for r in data.select("e", codec.decode_op(F.col("b")).alias("d")).collect()}
    assert rows["a"].meta["year"].i == 2**60 + 1 and rows["a"].vec == [1.0]
    assert rows["b"].op == 3 and rows["b"].meta is None and rows["c"].op is None
    bad = spark.createDataFrame([(bytearray(b"\x07"),)], "b binary").select(codec.decode_op(F.col("b")).alias("d")).first().d
    assert bad.op is None and "unknown operation" in bad._corrupt


def test_metric_names():
    assert [m.value for m in Metric] == ["l2", "dot", "cosine"]


def test_json(spark):
    from quillvec.functions import jsonio

    rows = ['{"a": 1, "b": 1.5, "c": "x", "d": true, "e": {"y": [1]}, "f": null, "g": 99999999999999999999}', "[1]", "{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.m for r in df.select("i", jsonio.metadata(F.col("t")).alias("m")).collect()}
    tags = {k: (v.t, v.i, v.d, v.s, v.b) for k, v in got[0].items()}
    assert tags["a"] == (f.INT, 1, None, None, None) and tags["b"][:3] == (f.DOUBLE, None, 1.5)
    assert tags["c"][3] == "x" and tags["d"][4] is True and tags["e"][3] == '{"y":[1]}' and tags["f"][3] == "null"
    assert tags["g"][0] == f.DOUBLE
    assert got[1] == got[2] == got[3] == {} and got[4] is None
    assert df.limit(2).select(jsonio.vector(F.col("t"))).collect()[1][0] == [1.0]
