"""Byte-level BPE as a token automaton (problem 6).

The merges of a public byte-level vocabulary are compiled into a deterministic automaton over
tokens that accepts exactly the token sequences BPE produces.  It starts as one state with a loop
for each of the 256 bytes.  Merge k, (a, b) -> ab, is one gadget:

* the state reached by ``a`` is replaced by a copy without the arc ``b``;
* every state that then has an arc ``a`` gets an arc ``ab``;
* ``ab`` leads to the state that ``b`` led to just before the gadget.

Written out, 50,000 states with up to 50,000 arcs each would not fit in memory.  A state is
therefore kept as a version, (token that leads to it, number of gadgets applied), and ``arc``
answers from the gadgets whether a version has an arc.  Each arc asked for is entered once in the
transition table, and encoding is driven by that table: reading a word left to right, exactly one
token ends at each byte position on a path of the automaton, so one pass finds the encoding.
Decoding writes out the bytes of the arc labels.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the public pre-splitting pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern where the text is ASCII, in the faster standard engine.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
# In the general pattern, white space is Unicode's property, without U+001C to U+001F.
_GENERAL = SPLIT.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(
    r"\s+(?!\S)|\s+", r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

CACHE_WORDS = 100_000  # entries of a worker's word cache; it is emptied when full
CACHE_BYTES = 64  # longer words are encoded each time


def _printable_bytes() -> dict[str, int]:
    """The printable stand-ins that the JSON vocabulary uses for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_merges(path: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """``(byte_ids, merges)``: the id of each byte, and ``(left, right, result)`` ids in order.

    Reads the JSON form (vocabulary and merges) or the rank form (base64 token and rank per line),
    from which the merge of each token is recovered as its last two parts under lower ranks.
    """
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back, vocab = _printable_bytes(), model["vocab"]
        byte_ids = [0] * 256
        for shown, byte in back.items():
            byte_ids[byte] = vocab[shown]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return byte_ids, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    byte_ids = [ranks[bytes([b])] for b in range(256)]
    automaton = Automaton(byte_ids, [])
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = automaton.encode_word(token)
            if len(parts) == 2:
                automaton.add_gadget(parts[0], parts[1], rank)
                merges.append((parts[0], parts[1], rank))
    return byte_ids, merges


class Automaton:
    """Deterministic token automaton of a byte-level BPE; see the module's text."""

    def __init__(self, byte_ids: Sequence[int], merges: Sequence[tuple[int, int, int]]):
        self.born: dict[int, int] = {}  # gadget that made the token; 0 for bytes
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}  # gadget that removed arc b behind token a
        self.label: dict[int, bytes] = {}
        self.entry: dict[bytes, int] = {}  # token, or -1 for a proper beginning of one
        self.table: dict[int, bool] = {}  # transition table, filled as arcs are asked for
        self.gadgets = 0
        for byte, i in enumerate(byte_ids):
            self.born[i] = 0
            self.label[i] = bytes([byte])
            self.entry[bytes([byte])] = i
        for a, b, ab in merges:
            self.add_gadget(a, b, ab)

    def add_gadget(self, a: int, b: int, ab: int) -> None:
        self.gadgets += 1
        self.born[ab] = self.gadgets
        self.left[ab], self.right[ab] = a, b
        self.cut[a, b] = self.gadgets
        label = self.label[ab] = self.label[a] + self.label[b]
        for n in range(2, len(label)):
            self.entry.setdefault(label[:n], -1)
        self.entry[label] = ab
        if self.table:
            self.table.clear()

    def arc(self, token: int, version: int, label: int) -> bool:
        """Whether the state behind ``token``, after ``version`` gadgets, has the arc ``label``."""
        while True:
            made = self.born[label]
            # Back through the copies, to the version that stood when the label was made.
            while True:
                if self.cut.get((token, label), version + 1) <= version:
                    return False
                if self.born[token] <= made:
                    break
                version = self.born[token] - 1
                token = self.right[token]
            if made == 0:
                return True
            version, label = made, self.left[label]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one pre-split word: the one path of the automaton that spells it."""
        entry, table, n = self.entry, self.table, len(word)
        whole = entry.get(word, -1)
        if whole >= 0:
            return (whole,)
        ends = [-1] * (n + 1)  # the token that ends at each position
        for at in range(n):
            before = ends[at]
            if before < 0 and at:
                continue
            stop = at + 1
            while stop <= n:
                label = entry.get(word[at:stop])
                if label is None:
                    break
                if label >= 0:
                    if before < 0:
                        ends[stop] = label
                    else:
                        key = before << 20 | label
                        there = table.get(key)
                        if there is None:
                            there = table[key] = self.arc(before, self.gadgets, label)
                        if there:
                            ends[stop] = label
                stop += 1
        out, at = [], n
        while at:
            out.append(ends[at])
            at -= len(self.label[ends[at]])
        return tuple(reversed(out))

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of the arc labels along a path."""
        return b"".join(self.label[i] for i in ids)


class Encoder:
    """Pre-splitting, automaton and a bounded word cache."""

    def __init__(self, byte_ids: Sequence[int], merges: Sequence[tuple[int, int, int]]):
        self.automaton = Automaton(byte_ids, merges)
        self.split = regex.compile(_GENERAL).findall
        self.split_ascii = re.compile(SPLIT_ASCII).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    def _new(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8", "surrogatepass")
        ids = self.automaton.encode_word(data)
        if len(data) <= CACHE_BYTES:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        return self.split_ascii(text) if text.isascii() else self.split(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; none for an empty or null text."""
        out: list[int] = []
        if text:
            cache, new, extend = self.cache.get, self._new, out.extend
            for word in self.words(text):
                extend(cache(word) or new(word))
        return out

    def count(self, text: str | None) -> int:
        """Number of ids of ``text``."""
        if not text:
            return 0
        cache, new = self.cache.get, self._new
        return sum(len(cache(word) or new(word)) for word in self.words(text))


_ENCODERS: dict[str, Encoder] = {}  # of this Python worker


def worker_encoder(shared, path: str) -> Encoder:
    """The worker's encoder for the broadcast merges, compiled once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(*shared.value)
    return _ENCODERS[path]


def _shared_merges(df: DataFrame, path: str):
    """Broadcast of the merges: its size is that of the vocabulary, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(load_merges(path))


def encode_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER
) -> DataFrame:
    """``(key, ids array<int>)`` of every row, in the vocabulary of the file ``tokenizer``.

    No special tokens are added, and their strings in a text are ordinary text.  Empty and null
    texts give an empty list; null keys and repeated rows keep their rows; an empty table gives
    none.  Other columns are ignored.  One narrow pass: no shuffle.
    """
    shared = _shared_merges(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, tokenizer)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, len(keys), 2000):
                ids, offsets = [], [0]
                for t in texts.slice(at, 2000).to_pylist():
                    ids += encoder.encode(t)
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 2000), lists], [key, "ids"])

    schema = StructType([docs.schema[key], StructField("ids", ArrayType(IntegerType(), False), False)])
    return docs.select(key, docs[text].cast("string")).mapInArrow(run, schema)


def count_tokens(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT_TOKENIZER
) -> DataFrame:
    """``(key, n_tokens int)`` of every row; 0 for empty and null texts."""
    shared = _shared_merges(docs, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared, tokenizer)
        for batch in batches:
            sizes = [encoder.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32())], [key, "n_tokens"])

    schema = StructType([docs.schema[key], StructField("n_tokens", IntegerType(), False)])
    return docs.select(key, docs[text].cast("string")).mapInArrow(run, schema)
