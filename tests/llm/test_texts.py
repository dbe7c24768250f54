"""Splitting, near copies, tokens and packing."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.llm import bpe, neardup, packing, split

TOKENIZER = bpe.DEFAULT_TOKENIZER


# -- problem 1 --------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^ \t\n\v\f\r]+")


def plain_paragraphs(text):
    out, run = [], 0
    for line in text.split("\n"):
        n = len(TOKEN.findall(line))
        if n:
            run += n
        elif run:
            out.append(run)
            run = 0
    return out + [run] * (run > 0)


texts = st.lists(st.sampled_from(["ab", "c.", "d-", " ", "\n", "\n\n", "\r\n", "\x0b", " ", "ß", "\t", "e!"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(0, 7), st.integers(0, 9))
def test_cuts(text, window, overlap):
    where = split.layout(text)
    assert [text[a:b] for a, b in zip(where.starts, where.ends)] == TOKEN.findall(text)
    assert (where.para_last - where.para_first).tolist() == plain_paragraphs(text)
    w, o = split.settings(window, overlap)
    got = split.cuts(where, w, o)
    n = len(where.starts)
    assert not got if n == 0 else got[0][0] == 0 and got[-1][1] == n
    for (a, b, kind), after in zip(got, [*got[1:], None]):
        assert 0 < b - a <= w
        if after:
            assert after[0] == b - o and after[1] > b
            assert kind != split.HARD or b - a == w


def test_cuts_prefer_strong_boundaries():
    kind = lambda text, w: split.cuts(split.layout(text), w, 0)[0][1:]
    assert kind("a b c\n\nd e. f g", 4) == (3, "paragraph")
    assert kind("a b c. d e f g", 4) == (3, "sentence")
    assert kind("a b c\nd e f g", 4) == (3, "line")
    assert kind("a b c-\nd e f g", 4) == (4, "hard")
    assert kind("a b c", 4) == (3, "whole")


def test_split_on_dirty_tables(spark):
    long = " ".join(["w"] * 50_000)
    docs = spark.createDataFrame(
        [(1, "a b c d\n\ne", "s", "x"), (1, "a b c d\n\ne", "s", "x"), (2, None, "s", "x"), (3, "", "s", "x"), (4, " \n ", None, "x"),
         (5, "a b c", None, "x"), (6, "a b c", "zero", "x"), (7, long, "big", "x"), (None, "a b c d", "s", "x")],
        "doc_id long, text string, source string, piece_no string",
    )
    config = spark.createDataFrame(
        [(1, "s", 3, 1), (2, "s", 99, 0), (3, "*", 2, None), (4, "zero", 0, 5), (5, "big", 1000, 999), (6, "unused", 5, 5)],
        "config_id int, source string, window_size int, overlap_size int",
    )
    found = sorted(((r.doc_id or 0), r.para_no) for r in split.oversized_paragraphs(docs, config).collect())
    assert found == [(0, 0), (1, 0), (1, 0), (5, 0), (6, 0), (7, 0)]
    rows = split.pieces(docs, config).collect()
    assert sorted(r.text for r in rows if r.doc_id == 6) == ["a", "b", "c"]
    assert [r.text for r in sorted((r for r in rows if r.doc_id == 5), key=lambda r: r.piece_no)] == ["a b", "c"]
    assert sum(r.doc_id == 7 for r in rows) == 49_001 and max(r.end_token - r.start_token for r in rows if r.doc_id == 7) == 1000
    assert not [r for r in rows if r.doc_id in (2, 3, 4)]
    assert split.pieces(docs.limit(0), config).count() == 0
    assert split.pieces(docs.where("doc_id = 5"), config.limit(0)).first().text == "a b c"


# -- problem 6 --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(*bpe.load_merges(TOKENIZER))


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_public_tokenizer(encoder, public, text):
    ids = encoder.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert encoder.automaton.decode(ids) == text.encode()
    assert encoder.count(text) == len(ids)


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 3000, " " * 500, "-" * 700, "ab" * 900, "x\x1c\x1fy\x85　z", "naïve ſoft­hyphen ﬁ", "'s 't 're I'll"])
def test_ids_of_odd_texts(encoder, public, text):
    assert encoder.encode(text) == public.encode(text, add_special_tokens=False).ids


def slow_bpe(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        best = min((i for i in range(len(parts) - 1)), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1e9), default=None)
        if best is None or (parts[best], parts[best + 1]) not in ranks:
            return parts
        parts[best : best + 2] = [parts[best] + parts[best + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12), st.lists(st.sampled_from(b"abc"), max_size=14))
def test_automaton_equals_merging_by_rank(choices, word):
    tokens, merges, ranks = [bytes([b]) for b in b"abc"], [], {}
    for x, y in choices:
        a, b = tokens[x % len(tokens)], tokens[y % len(tokens)]
        if (a, b) in ranks or a + b in tokens:
            continue
        # A merge is learnt from a text in which its parts stand side by side.
        if slow_bpe(a + b, ranks) != [a, b]:
            continue
        ranks[a, b] = len(ranks)
        tokens.append(a + b)
        merges.append((a, b))
    ids = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens[3:])}
    automaton = bpe.Automaton(range(256), [(ids[a], ids[b], ids[a + b]) for a, b in merges])
    assert [automaton.label[i] for i in automaton.encode_word(bytes(word))] == slow_bpe(bytes(word), ranks)


def test_encode_table(spark, public):
    rows = [(1, "Hello world", "c"), (2, None, "c"), (3, "", "c"), (None, "x", "c"), (1, "Hello world", "c"), (4, "long " * 20_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encode_texts(docs).collect()
    assert got == bpe.encode_texts(docs, tokenizer=TOKENIZER.replace(".json", ".tiktoken")).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted(
        (i or 0, public.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows
    )
    assert sorted(r.n_tokens for r in bpe.count_tokens(docs).collect()) == sorted(len(r.ids) for r in got)
    assert bpe.encode_texts(docs.limit(0)).count() == 0


# -- problem 7 --------------------------------------------------------------------------------------


def slow_fit(sizes, capacity):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=room.__getitem__)] -= s
        else:
            room.append(capacity - s)
    return len(room)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.lists(st.integers(1, 40), max_size=80))
def test_plan_equals_best_fit_of_single_items(capacity, sizes):
    sizes = [min(s, capacity) for s in sizes]
    fill, count = Counter(), Counter()
    for run in packing.plan(Counter(sizes).items(), capacity):
        for i in range(run.count):
            fill[run.base + i // run.each] += run.size
        count[run.size] += run.count
    assert count == Counter(sizes) and all(f <= capacity for f in fill.values())
    assert len(fill) == slow_fit(sizes, capacity)


def test_pack_table(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([7, 7, 7, r.randrange(0, 60), None])) for i in range(500)] + [(1, 7), (None, 3), (900, 250)]
    rows = spark.createDataFrame(sizes, "doc_id long, n_tokens int").repartition(5)
    config = spark.createDataFrame([(1, 50), (2, 20), (2, 30), (3, None), (4, 0)], "pack_id int, capacity int")
    got = packing.pack(rows, config).collect()
    for pack, capacity in ((1, 50), (2, 20)):
        mine = [g for g in got if g.pack_id == pack]
        fill, of = Counter(), Counter()
        for g in mine:
            if g.size:
                fill[g.container_no] += g.size
            else:
                assert g.container_no is None
            of[g.doc_id] += g.size
        want = Counter()
        for i, n in sizes:
            want[i] += n or 0
        assert of == want and max(fill.values()) <= capacity and set(fill) == set(range(len(fill)))
        assert sorted(g.size for g in mine if g.doc_id == 900) == sorted([capacity] * (250 // capacity) + [250 % capacity] * (250 % capacity > 0))
        assert all(g.piece_no == 0 for g in mine if want[g.doc_id] <= capacity and g.doc_id != 1)
    assert {g.pack_id for g in got} == {1, 2}
    report = {x.pack_id: x for x in packing.fill_report(packing.pack(rows, config), config).collect()}
    assert report[1].containers >= report[1].least_possible
    assert packing.pack(rows.limit(0), config).count() == packing.pack(rows, config.limit(0)).count() == 0


# -- problem 4 --------------------------------------------------------------------------------------


def page(r, n=60):
    words = ["harbour", "cattle", "meeting", "printer", "loom", "bridge", "voyage", "tariff", "orchard", "lantern"]
    return " ".join(r.choice(words) + str(r.randrange(99)) for _ in range(n))


def edited(r, text, share):
    out = list(text)
    for i in range(len(out)):
        if r.random() < share:
            out[i] = r.choice("abcxyz")
    return "".join(out)


def plain_norm(t):
    return re.sub("[ \t\n\v\f\r]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)).strip(" ")


def plain_jaccard(a, b):
    x, y = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def near():
    r = random.Random(8)
    rows = []
    for i in range(60):
        base = page(r)
        rows.append((f"d{i}", base))
        for j in range(r.randrange(3)):
            rows.append((f"d{i}-{j}", edited(r, base, r.choice([0.0, 0.01, 0.03, 0.05]))))
    rows += [("up", rows[0][1].upper()), ("sp", "\n" + rows[0][1].replace(" ", " \t\r\n")), ("short", "abc" * 20), ("null", None), ("e", "")]
    r.shuffle(rows)
    known = [(k, plain_norm(t)) for k, t in rows if t]
    known = [(k, t) for k, t in known if len(t) >= 200]
    pairs = {
        (min(a, b), max(a, b)) for i, (a, s) in enumerate(known) for b, t in known[:i] if plain_jaccard(s, t) >= 0.5
    }
    return rows, pairs


def test_near_copies_equal_brute_force(spark, near):
    rows, pairs = near
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "key string, text string").withColumn("uid", F.lit("clash"))
    got = neardup.near_copies([("document", df), ("chunk", df.where("key like 'd1%'"))]).collect()
    assert {(g.key_a, g.key_b) for g in got if g.kind == "document"} == pairs
    assert {(g.key_a, g.key_b) for g in got if g.kind == "chunk"} == {p for p in pairs if p[0][:2] == p[1][:2] == "d1"}
    assert len(got) == len({tuple(g) for g in got})
    assert neardup.near_copies([("document", df.limit(0))]).count() == 0


def test_groups_equal_connected_pairs(spark, near):
    rows, pairs = near
    df = spark.createDataFrame(rows, "key string, text string")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = Counter()
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
        links[a] += 1
        links[b] += 1
    for g in neardup.groups([("document", df)]).collect():
        assert g.group_key == find(g.key) and g.links == links[g.key]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(7, 7)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {j: 100 for j in range(100, 130)}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_masks_cover_two_differences():
    for a in range(7):
        for b in range(7):
            assert any(a not in line and b not in line for line in neardup.LINES)
