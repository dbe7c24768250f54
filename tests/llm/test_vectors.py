"""Varied subsets, clusters and neighbours."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.llm import clusters, neighbours, subset
from quillvec.llm.vectors import unit_vectors
from quillvec.sources.store import OPS

DIM = 16


def op_log(spark, vectors):
    rows = [(n + 1, 1, key, None if v is None else [float(x) for x in v], None) for n, (key, v) in enumerate(vectors)]
    return spark.createDataFrame(rows + rows[:3], OPS).withColumn("cluster", F.lit("clash"))


def planted(seed=1, sizes=(120, 60, 25), noise=40, spread=0.6):
    r = np.random.default_rng(seed)
    centres = np.linalg.qr(r.normal(size=(DIM, DIM)))[0][: len(sizes)]
    out = []
    for c, n in enumerate(sizes):
        for i in range(n):
            off = r.normal(size=DIM)
            off -= (off @ centres[c]) * centres[c]
            out.append((f"c{c}-{i}", (centres[c] + spread * off / np.linalg.norm(off)) * r.uniform(0.5, 2)))
    others = np.linalg.qr(r.normal(size=(DIM, DIM)))[0]
    for i in range(noise):
        v = r.normal(size=DIM)
        v -= sum((v @ c) * c for c in centres)
        out.append((f"n-{i}", v if i else others[0] * 0))
    return out, centres


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(0, 9), st.integers(1, 50), max_size=8), st.integers(0, 120))
def test_quotas(sizes, slots):
    got = subset.quotas(sizes, slots)
    assert sum(got.values()) == min(slots, sum(sizes.values()))
    assert all(0 <= got[c] <= n for c, n in sizes.items())


def test_quotas_grow_with_the_square_root():
    assert subset.quotas({0: 10_000, 1: 100}, 24) == {0: 21, 1: 3}
    assert subset.quotas({0: 9, 1: 4, 2: 1}, 2) == {0: 1, 1: 1, 2: 0}
    assert subset.quotas({0: 10_000, 1: 1, 2: 1}, 50) == {0: 48, 1: 1, 2: 1}


def test_subset_of_vectors_covers_the_small_clusters(spark):
    rows, _ = planted(sizes=(800, 60, 20), noise=1)
    log = op_log(spark, rows)
    got = subset.from_vectors(log, [(1, 40), (2, 5000), (3, 0), (4, None)], DIM).collect()
    first = [r.ext_id for r in got if r.request_id == 1]
    assert len(first) == len(set(first)) == 40
    assert sum(i.startswith("c0") for i in first) < 36 and any(i.startswith("c2") for i in first)
    assert {r.ext_id for r in got if r.request_id == 2} == {k for k, _ in rows}
    assert {r.request_id for r in got} == {1, 2}
    assert subset.from_vectors(log.limit(0), [(1, 5)], DIM).count() == 0
    assert [r.ext_id for r in subset.from_vectors(op_log(spark, [("z", [0.0] * DIM)]), [(1, 5)], DIM).collect()] == ["z"]


def test_subset_of_retrieved_rows(spark):
    rows = [(1, n, "big", f"t{n}") for n in range(1, 8)] + [(1, 8, "small", "s"), (1, 9, "copy", "T1 "), (1, 9, "copy", "T1 ")]
    rows += [(2, None, None, None), (2, 1, "a", "x"), (2, 1, "a", "x")]
    df = spark.createDataFrame(rows, "qid long, rank_no int, doc_id string, text string").withColumn("place", F.lit(0))
    got = {}
    for r in subset.per_query(df, [(7, 3), (8, 99)]).collect():
        got.setdefault((r.request_id, r.qid), []).append((r.place, r.doc_id, r.rank_no))
    assert [x[1:] for x in sorted(got[7, 1])] == [("big", 1), ("small", 8), ("big", 2)]
    assert len(got[8, 1]) == 9 and [x[1] for x in sorted(got[8, 1])][-1] == "copy"
    assert [x[1] for x in sorted(got[7, 2])] == ["a", None]
    assert subset.per_query(df, []).count() == subset.per_query(df.limit(0), [(1, 3)]).count() == 0


def test_clusters_are_the_planted_ones(spark):
    rows, centres = planted()
    log = op_log(spark, [*rows, ("short", [1.0]), ("null", None)])
    anchors = spark.createDataFrame(
        [(0, centres[0].tolist()), (1, centres[1].tolist()), (9, (centres[1] * 3).tolist()), (5, None), (6, [1.0]), (7, [0.0] * DIM), (None, centres[0].tolist())],
        "anchor_id int, vec array<float>",
    )
    members = {r.ext_id: r.cluster for r in clusters.memberships(log, anchors, DIM).collect()}
    assert set(members) == {k for k, _ in rows} and members["n-0"] is None
    own = [{members[k] for k, _ in rows if k.startswith(f"c{c}-")} for c in range(3)]
    assert all(len(o) == 1 for o in own) and len(set.union(*own)) == 3 and None not in set.union(*own)
    pairs = {(r.anchor_id, r.ext_id) for r in clusters.anchored(log, anchors, DIM).collect()}
    assert pairs == {(a, k) for a, c in ((0, 0), (1, 1), (9, 1)) for k, _ in rows if members[k] in own[c]}
    told = {r.cluster: r for r in clusters.described(log, anchors, DIM).collect()}
    assert sum(r["size"] for r in told.values()) == len(rows)
    big = told[own[0].pop()]
    assert big.least_cosine >= clusters.REACH and len(big.typical) == 5
    assert clusters.anchored(log.limit(0), anchors, DIM).count() == 0
    same = op_log(spark, [(f"s{i}", [1.0] * DIM) for i in range(30)])
    assert {r.cluster for r in clusters.memberships(same, anchors.limit(0), DIM).collect()} == {0}


def test_small_clusters_in_a_large_log(spark):
    r = np.random.default_rng(8)
    dim = 48
    centres = np.linalg.qr(r.normal(size=(dim, dim)))[0][:4]
    sizes = (12_000, 6_000, 30, 9)
    x = np.vstack([centres[c] + 0.5 / np.sqrt(dim) * r.normal(size=(n, dim)) for c, n in enumerate(sizes)] + [r.normal(size=(2_000, dim))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    means = clusters.cluster_means(spark.createDataFrame([(v.tobytes(),) for v in x], "v binary").cache(), dim)
    assert len(means) == len(sizes) and ((centres @ means.T) > 0.9).sum() == len(sizes)


def brute(ids, x, k, least=-1.0):
    order = sorted(range(len(ids)), key=lambda i: ids[i].encode())
    ids, x = [ids[i] for i in order], x[order] / np.linalg.norm(x[order], axis=1)[:, None]
    cosine = x @ x.T
    out = {}
    for i, key in enumerate(ids):
        best = sorted((j for j in range(len(ids)) if j != i and cosine[i, j] >= least - 1e-6), key=lambda j: (-round(cosine[i, j], 6), j))[:k]
        out[key] = [ids[j] for j in best]
    return out


def test_neighbours_reach_their_recall(spark):
    rows, _ = planted(sizes=(300, 200, 100), noise=60)
    rows = [(k, v) for k, v in rows if np.any(v)]
    df = spark.createDataFrame([(k, [float(t) for t in v]) for k, v in rows] + [("zero", [0.0] * DIM)], "ext_id string, vec array<float>")
    units = unit_vectors(df, "ext_id", "vec", DIM)
    truth = brute([k for k, _ in rows], np.array([v for _, v in rows]), 10)
    got = {}
    for r in neighbours.most_similar(units, 10, dim=DIM, lists=9, probes=6, books=8, fine=64).collect():
        got.setdefault(r.ext_id, []).append(r.other)
    assert set(got) == set(truth)
    assert np.mean([len(set(got[k]) & set(truth[k])) / 10 for k in truth]) >= 0.9
    some = neighbours.most_similar(units, 3, queries=F.col("ext_id").startswith("c1-1"), dim=DIM).collect()
    assert {r.ext_id for r in some} == {k for k in truth if k.startswith("c1-1")}
    assert all(r.rank_no <= 3 and r.other != r.ext_id for r in some)


def test_mutual_pairs_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows, _ = planted(sizes=(80, 40), noise=20)
    near = [(f"{k}+{j}", v + r.normal(0, 0.02, DIM)) for k, v in rows[:60] for j in range(2)]
    equal = [(f"same{i:02d}", [1.0] + [0.5] * (DIM - 1)) for i in range(25)]
    rows = [(k, np.float32(v)) for k, v in [*rows, *near, *equal]]
    monkeypatch.setattr(neighbours, "BLOCK_RECORDS", 40)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 50)
    got = {(p.ext_a, p.ext_b) for p in neighbours.mutual_pairs(op_log(spark, rows), dim=DIM).collect()}
    kept = [(k, v) for k, v in rows if np.any(v)]
    top = brute([k for k, _ in kept], np.array([v for _, v in kept], np.float64), 10, 0.96)
    assert got == {(a, b) for a in top for b in top[a] if a < b and a in top[b]}
    assert neighbours.mutual_pairs(op_log(spark, rows).limit(0), dim=DIM).count() == 0


def test_passes_bound_the_visits_and_change_no_pair(spark, monkeypatch):
    assert neighbours.passes_for(0, 0) == neighbours.passes_for(neighbours.LEAST_VISITS, 1) == 1
    assert neighbours.passes_for(13 * 10**6, 10**6) == 4 and neighbours.passes_for(61 * 10**8, 10**8) == 16
    rows, _ = planted(sizes=(120, 60), noise=20)
    rng = np.random.default_rng(7)
    rows += [(f"{k}+{j}", v + rng.normal(0, 0.02, DIM)) for k, v in rows[:80] for j in range(2)]
    rows = [(k, np.float32(v)) for k, v in rows if np.any(v)]
    monkeypatch.setattr(neighbours, "LIST_RECORDS", 20)
    log, disk = op_log(spark, rows), spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    names, write, before = [], neighbours.written, shuffled()

    def seen(df, name, **more):
        names.append(name)
        return write(df, name, **more)

    monkeypatch.setattr(neighbours, "written", seen)
    one = set(map(tuple, neighbours.mutual_pairs(log, dim=DIM).collect()))
    assert names.count("met") == 1
    monkeypatch.setattr(neighbours, "PASS_VISITS", 2)
    monkeypatch.setattr(neighbours, "LEAST_VISITS", 1)
    before |= shuffled()
    pairs = neighbours.mutual_pairs(log, dim=DIM)  # its steps are over, and it isn't read yet
    for _ in range(50):
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert names.count("met") >= 4 and not left
    top = brute([k for k, _ in rows], np.array([v for _, v in rows], np.float64), 10, 0.96)
    assert set(map(tuple, pairs.collect())) == one == {(a, b) for a in top for b in top[a] if a < b and a in top[b]}
    thorough = lambda: sorted(neighbours.most_similar(units, 5, lists=9, probes=6, dim=DIM).collect())
    units = unit_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in rows], "ext_id string, vec array<float>"), "ext_id", "vec", DIM)
    several = thorough()
    monkeypatch.setattr(neighbours, "LEAST_VISITS", 1 << 20)
    assert several == thorough() and len(several) == 5 * len(rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_lists_meet_near_pairs_at_every_size():
    r = np.random.default_rng(3)
    x, off = r.normal(size=(2, 8000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.96 * x + 0.28 * off / np.linalg.norm(off, axis=1, keepdims=True)
    missed = {}
    for lists in (64, 640):
        books = neighbours.fit_codebooks(x, lists, 2)
        probes = neighbours.probes_among(lists)
        home = lambda z: (lambda c: c[:, 0].astype(int) * len(books.books[1]) + c[:, 1])(books.encode(z))  # noqa: B023, E731
        met = [(books.nearest_lists(a[:2000], probes) == home(b[:2000])[:, None]).any(axis=1) for a, b in ((x, y), (y, x))]
        missed[lists] = np.mean(~(met[0] | met[1]))
    assert neighbours.probes_among(64) == 6 and missed[640] <= max(0.01, 2 * missed[64]), missed


def test_encoding_beats_a_single_codebook():
    x = np.random.default_rng(2).normal(size=(500, 8)).astype(np.float32)
    books = neighbours.fit_codebooks(x, 16, 4, 16)
    left = np.linalg.norm(x - books.decode(books.encode(x, 4)), axis=1).mean()
    first = neighbours.Codebooks(books.books[:1])
    assert left < np.linalg.norm(x - first.decode(first.encode(x)), axis=1).mean() * 0.8
    assert left <= np.linalg.norm(x - books.decode(books.encode(x, 1)), axis=1).mean() + 1e-6


@pytest.mark.parametrize("rows", [1, 2, 3])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame([(f"k{i}", [1.0, float(i)]) for i in range(rows)], "ext_id string, vec array<float>")
    got = neighbours.most_similar(unit_vectors(df, "ext_id", "vec", 2), 5, dim=2).collect()
    assert len(got) == rows * (rows - 1)


def _units(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _with_small_clusters(count, dim=48):
    """``count`` unrelated unit vectors and clusters of 3, 5, 15 and 40, and the clusters' directions."""
    rng = np.random.default_rng(8)
    noise, centres = _units(rng.normal(size=(count, dim))), _units(rng.normal(size=(4, dim)))
    parts = [_units(centres[k] + rng.normal(size=(m, dim)) * s) for k, (m, s) in enumerate(((3, 0.02), (5, 0.04), (15, 0.04), (40, 0.12)))]
    return np.concatenate([noise, *parts]), centres


@pytest.mark.parametrize("count", [300, 20_000])
def test_a_task_finds_small_clusters_at_every_size(count):
    x, centres = _with_small_clusters(count)
    made = [clusters.unit(s) for tree in range(clusters.TREES) for _, s in clusters.divided(x, len(x), tree)]
    for c in centres:
        assert max(float(c @ m) for m in made) > 0.75


def test_unrelated_vectors_make_no_cluster():
    x = _units(np.random.default_rng(3).normal(size=(5000, 48)))
    assert clusters.divided(x, len(x)) == []
    assert clusters.divided(x[:2], 2) == [] and clusters.divided(x[:0], 0) == []


def test_small_clusters_among_nodes_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LOCAL", 2000)  # so that the tree is split across tasks
    x, centres = _with_small_clusters(9000)
    rows = spark.createDataFrame([(v.tobytes(),) for v in x], "v binary").repartition(4).cache()
    means, leaves = clusters.found_clusters(rows, 48)
    assert len(means) == len(leaves) and min(leaves) >= 1
    for c in centres:
        assert (means @ c).max() > 0.9
    assert len(means) == len(centres)


def test_trees_share_passes_and_means_that_stand_still_are_not_compared_again(spark, monkeypatch):
    monkeypatch.setattr(clusters, "LOCAL", 2000)
    x, centres = _with_small_clusters(9000)
    rows = spark.createDataFrame([(v.tobytes(),) for v in x], "v binary").repartition(4).cache()
    passes, added = [], clusters._added

    def counted(rows, run):
        passes.append(added(rows, run))
        return passes[-1]

    monkeypatch.setattr(clusters, "_added", counted)
    means, _ = clusters.found_clusters(rows, 48)
    assert len(means) == len(centres) and ((centres @ means.T) > 0.9).any(axis=1).all()
    assert len(passes) <= 20  # 30 with one tree at a time
    passes.clear()
    assert len(clusters._shifted(rows, 48, [means[0], clusters.unit(means[1] + means[2] / 2)], len(x))) == 2
    assert [len(p) for p in passes[:2]] == [2, 1]


def test_chance_falls_with_closeness_and_rises_with_the_records():
    assert clusters.chance(1000, 5, 0.96, 48) < clusters.chance(1000, 5, 0.8, 48) < clusters.chance(10**6, 5, 0.8, 48)
    assert clusters.chance(1000, 3, 1.0, 48) == -np.inf and clusters.chance(1000, 1, 1.0, 48) == np.inf
    n = clusters.needed(1000, 48, 20)
    assert all(a >= b for a, b in zip(n[3:], n[4:]))


def _moments_of(parts):
    return {k: (float(len(p)), p.sum(axis=0).astype(float), (p.T @ p).astype(float)) for k, p in enumerate(parts)}


def test_pieces_of_a_group_are_joined_and_groups_that_share_a_direction_are_not():
    rng = np.random.default_rng(4)
    blob = rng.normal(size=(4000, 48)) * 0.1 + rng.normal(size=48)
    cut = [blob[blob[:, 0] > np.median(blob[:, 0])], blob[blob[:, 0] <= np.median(blob[:, 0])]]
    shared = rng.normal(size=48) * 2
    apart = [rng.normal(size=(50, 48)) * 0.1 + shared + rng.normal(size=48) for _ in range(62)]
    group = subset.joined(_moments_of(cut + apart), 65)
    assert group[0] == group[1] and len(set(group.tolist())) == 64


def test_subset_covers_distinct_groups_of_one_direction(spark):
    rng = np.random.default_rng(6)
    base = np.ones(DIM)
    centres = [base + 0.9 * np.sqrt(DIM) * v / np.linalg.norm(v) for v in rng.normal(size=(30, DIM))]
    rows = [(f"c{c}-{i}", (centres[c] + rng.normal(size=DIM) * 0.1).tolist()) for c in range(30) for i in range(900 if c == 0 else 20)]
    log = op_log(spark, rows)
    got = [r.ext_id.split("-")[0] for r in subset.from_vectors(log, [(1, 60)], DIM).collect()]
    assert len(got) == 60 and len(set(got)) == 30 and got.count("c0") <= 15
