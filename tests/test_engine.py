"""Collections, durability, byte logs, streams."""

import os

import pytest
from pyspark.sql import functions as F

from quillvec.config import ChunkConfig, CollectionConfig, IndexKind, Metric, Persistence, RagConfig, SyncPolicy
from quillvec.engine import Collection, RagEngine
from quillvec.functions import filters as f
from quillvec.operators import oplog
from quillvec.sources import wal
from quillvec.sources.store import OPS, Blobs
from quillvec.streaming import fold


def ids(df):
    return [r.ext_id for r in df.collect()]


@pytest.mark.parametrize("index", [IndexKind.FLAT, IndexKind.IVF])
def test_collection_in_memory(spark, index):
    c = Collection(spark, CollectionConfig(2, Metric.L2, index))
    assert ids(c.search([0, 0], 3)) == []
    assert [c.insert(i, v, m) for i, v, m in (("a", [0, 0], {"lang": "en"}), ("b", [1, 0], {"lang": "fr"}), ("c", [5, 0], {"lang": "fr"}))] == [0, 1, 2]
    assert ids(c.search([0, 0], 2)) == ["a", "b"]
    assert ids(c.search([0, 0], 5, f.eq("lang", "fr"))) == ["b", "c"]
    assert c.update("b", [9, 0]) and c.metadata("b") == {"lang": "fr"}
    assert c.update("b", [9, 0], {}) and c.metadata("b") == {}
    assert not c.update("zz", [1, 1]) and not c.erase("zz")
    assert c.erase("a") and c.resolve("a") is None and not c.is_live("a") and c.get("a") is None
    assert not c.update("a", [1, 1])
    assert c.size() == 2 and c.slot_count() == 3
    assert c.insert("a", [2, 0]) == 0 and c.external_id(0) == "a"
    assert ids(c.search([0, 0], 9)) == ["a", "c", "b"]
    c.erase("a")
    c.compact()
    assert c.slot_count() == 2 and c.resolve("b") == 0 and c.external_id(1) == "c"
    assert c.insert("d", [0, 1]) == 2
    stats = c.stats().first()
    assert (stats.metric, stats["index"], stats["size"]) == ("l2", index.value, 3)
    with pytest.raises(ValueError):
        c.insert("x", [1.0])
    with pytest.raises(ValueError):
        c.search([1.0], 0)
    with pytest.raises(ValueError):
        c.search_batch(spark.createDataFrame([(1, [1.0])], "qid int, qv array<float>"), 1)


def test_apply_ops_logs_only_effective_ones(spark):
    c = Collection(spark, CollectionConfig(1, Metric.L2))
    rows = [(1, 2, "a", [1.0], None), (2, 1, "a", [2.0], None), (3, 3, "a", None, None), (4, 3, "a", None, None), (5, 1, "b", [3.0], None)]
    out = {r.order: r.effective for r in c.apply_ops(spark.createDataFrame(rows, OPS)).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert c.log().count() == 3 and ids(c.state()) == ["b"]
    with pytest.raises(ValueError):
        c.apply_ops(spark.createDataFrame([(1, 1, "x", [1.0, 2.0], None)], OPS))
    assert c.log().count() == 3


def test_durable_collection_recovers(spark, tmp_path):
    config = CollectionConfig(1, Metric.L2, persistence=Persistence(str(tmp_path / "c")))
    c = Collection(spark, config)
    for i in range(4):
        c.insert(f"v{i}", [i], {"n": i})
    c.erase("v0")
    c.update("v1", [10])
    c.snapshot()
    c.insert("late", [7])
    again = Collection(spark, config)
    assert again.durable and sorted(ids(again.state())) == ["late", "v1", "v2", "v3"]
    assert again.get("v1") == [10.0] and again.metadata("v1") == {"n": 1}
    assert again.log().count() == 4
    again.erase("late")
    again.compact()
    third = Collection(spark, config)
    assert third.slot_count() == 3 and third.size() == 3 and third.resolve("v1") == 0


def test_sync_policies(spark, tmp_path):
    held = CollectionConfig(1, persistence=Persistence(str(tmp_path / "g"), SyncPolicy.GROUP))
    c = Collection(spark, held)
    c.insert("a", [1.0])
    assert Collection(spark, held).size() == 0
    c.flush()
    assert Collection(spark, held).size() == 1
    off = CollectionConfig(1, persistence=Persistence(str(tmp_path / "o"), SyncPolicy.OFF))
    c = Collection(spark, off)
    c.insert("a", [1.0])
    c.flush()
    assert Collection(spark, off).size() == 0
    c.close()
    assert Collection(spark, off).size() == 1


def test_blobs(spark, tmp_path):
    b = Blobs(spark, str(tmp_path / "blobs"))
    assert not b.exists("x")
    with pytest.raises(FileNotFoundError):
        b.get("x")
    for data in (b"a\0b\xff", b"", b"second"):
        b.put("x", data)
        assert b.get("x") == data


def test_byte_log_round_trip_and_torn_tail(spark, tmp_path):
    rows = [(n, 1 + n % 3, f"k{n}", None if n % 3 == 2 else [float(n)], f.meta_map({"n": n}) if n % 3 == 0 else None) for n in range(1, 40)]
    folder = str(tmp_path / "log")
    wal.write(spark.createDataFrame(rows, OPS), folder)
    back = wal.read(spark, folder).orderBy("file", "record_no").collect()
    assert [(r.op, r.ext_id, r.vec) for r in back] == [(op, e, v) for _, op, e, v, _ in rows]
    assert back[2].meta["n"].i == 3 and back[0].meta is None
    last = sorted(p for p in os.listdir(folder) if p.endswith(".log"))[-1]
    path = os.path.join(folder, last)
    with open(path, "ab") as out:
        out.write(b"\x01\x02\x03")
    for c in os.listdir(folder):
        if c.endswith(".crc"):
            os.remove(os.path.join(folder, c))
    assert wal.read(spark, folder).count() == len(rows)


def test_stream_equals_batch(spark, tmp_path):
    r = [(n, 1 if n % 5 == 1 else 3 if n % 7 == 0 else 2, f"k{n % 6}", None if n % 7 == 0 and n % 5 != 1 else [float(n)], None) for n in range(1, 120)]
    df = spark.createDataFrame(r, OPS)
    df.orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "ops"))
    run = fold.fold_stream(fold.read_ops(spark, str(tmp_path / "ops"), 2), 1).writeStream.outputMode("complete").format("memory").queryName("folded")
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {x.ext_id: x.vec for x in spark.table("folded").where("live").collect()}
    assert got == {x.ext_id: x.vec for x in oplog.fold(df, 1).collect()}


def test_effects_stream_takes_late_operations(spark, tmp_path):
    rows = [(n, 1 if n % 6 == 2 else 3 if n % 5 == 0 else 2, f"k{n % 3}", None if n % 5 == 0 and n % 6 != 2 else [float(n)], None) for n in range(1, 90)]
    df = spark.createDataFrame(rows + rows[10:20], OPS)
    df.orderBy(F.rand(5)).repartition(6).write.parquet(str(tmp_path / "ops"))
    saved = str(tmp_path / "saved")
    stream = fold.effects_stream(fold.read_ops(spark, str(tmp_path / "ops"), 1), 1)
    run = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{saved}/b={n}"))
    run.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {x.lsn: (x.op, x.ext_id, x.effective) for x in fold.latest_effects(spark.read.parquet(saved)).collect()}
    assert got == {x.lsn: (x.op, x.ext_id, x.effective) for x in oplog.effects(df, 1).collect()} and len(got) == 89


def test_effects_of_a_hot_key_span_ranges(spark):
    rows = [(n, 1 if n in (7, 60) else 3 if n == 40 else 2, "hot" if n % 10 else f"k{n}", [1.0], None) for n in range(100)]
    df = spark.createDataFrame(rows, OPS).repartition(5)
    want, live = {}, {}
    for lsn, op, key, _, _ in rows:
        want[lsn] = op == 1 or live.get(key, False)
        live[key] = op == 1 if op != 2 else live.get(key, False)
    assert {r.lsn: r.effective for r in oplog.effects(df, 1).collect()} == want


@pytest.mark.parametrize("step", ["put", "delete", "rename"])
def test_a_crash_while_truncating_loses_nothing(spark, tmp_path, monkeypatch, step):
    config = CollectionConfig(1, persistence=Persistence(str(tmp_path / "c"), SyncPolicy.ALWAYS))
    c = Collection(spark, config)
    for k in "abc":
        c.insert(k, [1.0])
    store = c._store
    store.publish(c.state().join(c.slots().select("ext_id", "internal_id"), "ext_id"), 2)  # the tail holds lsn 3

    def crash(*a):
        raise OSError("crash")

    with monkeypatch.context() as m:
        m.setattr(Blobs, {"put": "put", "delete": "delete", "rename": "_replace"}[step], crash)
        with pytest.raises(OSError):
            store.truncate()
    assert Collection(spark, config).size() == 3
    store.truncate()
    again = Collection(spark, config)
    assert again.size() == 3 and store.ops().count() == 1
    again.insert("d", [2.0])
    assert Collection(spark, config).size() == 4


def test_a_torn_first_put_is_not_read(spark, tmp_path):
    config = CollectionConfig(1, persistence=Persistence(str(tmp_path / "c"), SyncPolicy.ALWAYS))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "CURRENT.0.tmp").write_bytes(b"{")
    c = Collection(spark, config)
    c.insert("a", [1.0])
    c.snapshot()
    assert Collection(spark, config).size() == 1


def test_promoted_metadata_reach_the_scan_of_a_snapshot(spark, tmp_path):
    config = CollectionConfig(1, persistence=Persistence(str(tmp_path / "c"), SyncPolicy.ALWAYS))
    plain = Collection(spark, CollectionConfig(1))
    c = Collection(spark, config, promoted={"year": "year"})
    metas = {"a": {"year": 2020}, "b": {"year": 2021.5}, "c": {"year": "2020"}, "d": {}, "e": {"year": True}}
    tests = [f.eq("year", 2020), f.ne("year", 2020), f.negate(f.eq("year", 2020)), f.ge("year", 2021.0), f.is_in("year", ["2020", 2020]),
             f.negate(f.lt("year", 2021)), f.eq("year", True), f.all_of(f.eq("year", 2020), f.negate(f.eq("lang", "x")))]

    def same():
        for t in tests:
            assert {r.ext_id for r in c.search([1.0], 9, t).collect()} == {r.ext_id for r in plain.search([1.0], 9, t).collect()}, t

    for k, m in metas.items():
        for e in (c, plain):
            e.insert(k, [1.0], m)
    same()
    c.snapshot()
    same()
    kept = f.where(c.state(), f.eq("year", 2020), promoted=c.promoted)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year.i,2020)" in plan
    for e in (c, plain):
        e.insert("f", [1.0], {"year": 2020})
        e.update("a", [1.0], {"year": 1999})
        e.erase("b")
    same()
    assert {r.ext_id for r in Collection(spark, config).search([1.0], 9, f.eq("year", 2020)).collect()} == {"f"}


def test_retrieval_by_the_configured_index(spark):
    e = RagEngine(spark, RagConfig(index=IndexKind.IVF))
    e.ingest_all(spark.createDataFrame([(f"d{n}", f"topic{n} alpha{n} common words here") for n in range(12)], "doc_id string, text string"))
    assert e.retrieve("topic7 alpha7").first().doc_id == "d7" and e._index is not None
    assert e.stats().first()["index"] == "ivf"


def test_rag_life_cycle(spark):
    e = RagEngine(spark, RagConfig(chunk=ChunkConfig(4, 1)))
    assert e.retrieve("anything").count() == 0 and e.document_count() == 0
    assert e.ingest("d", " ".join(f"word{i}" for i in range(20))) == 7
    assert e.ingest("d", "three short words") == 1 and e.document_count() == 1
    assert e.ingest("empty", " ") == 0 and e.document_count() == 1
    assert not e.remove("nope") and e.remove("d") and not e.remove("d")
    assert e.ingest("d", "back again here") == 1
    assert e.retrieve("back again").first().doc_id == "d"
    assert "- back again here\n" in e.build_prompt("back again")
    assert e.stats().first().chunks == 1
