"""Noisy-channel reading of disguised and damaged text.

What stands on a page is taken for words sent through a channel that may put a digit or sign for a
letter, repeat letters, hide letters behind marks or dashes, drop accents, misread letters, space a
word out or run words together.  A token is a lattice: each character may stand for one of several
letters at a cost.  Viterbi decoding finds the cheapest path through the lattice twice: through the
words of a vocabulary, and through free letters under a character language model (trigrams counted
over all texts).  The token is read as the word if that path is the likelier one, else as the
letters.  Run-on text is a lattice of words and of free letters between which the model puts the
lost spaces.  There is no limit of length and no beam: the states are pairs of letters, or nodes of
the tree of the vocabulary.

Plain misreadings of scans are looked up; a reading that is itself a common word of the texts, by
their counts, is left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäåæçèéêëíîïñóôöøœùúûüß"
ALPHABET = " " + LETTERS + "#"  # '#' for any other character
_N = len(ALPHABET)
_SLOT = {c: i for i, c in enumerate(ALPHABET)}
_FOLD = np.full(0x180, _N - 1, np.int64)
for _i in range(0x180):
    _FOLD[_i] = 0 if chr(_i) in " \t\n\v\f\r\xa0" else _SLOT.get(chr(_i).lower(), _N - 1)

# Readings of a character that is not the letter it stands for.
LEET: dict[str, str] = {
    "0": "oö", "1": "il", "2": "z", "3": "e", "4": "aåä", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gq", "@": "aåä",
    "$": "s", "€": "e", "£": "l", "!": "i", "|": "il", "+": "t", "¡": "i", "¢": "c", "¥": "y", "(": "c", "<": "c",
}
ACCENTS: tuple[str, ...] = ("aàáâäå", "eèéêë", "iíîï", "oóôöø", "uùúûü", "nñ", "cç")
# Misreadings of scans: what is printed, and what it is read as.
MISREAD: tuple[tuple[str, str], ...] = (
    ("e", "c"), ("c", "e"), ("e", "o"), ("o", "e"), ("o", "a"), ("a", "o"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"),
    ("w", "vv"), ("t", "f"), ("f", "t"), ("r", "t"), ("n", "u"), ("u", "n"), ("h", "b"), ("b", "h"), ("y", "v"), ("v", "y"),
    ("l", "i"), ("i", "l"), ("l", "1"), ("i", "1"), ("s", "f"), ("s", "5"), ("g", "q"), ("q", "g"), ("o", "0"), ("g", "9"),
    ("c", "("), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("å", "a"), ("é", "e"), ("è", "e"), ("ß", "b"), ("ß", "ss"), ("ü", "ii"),
)
COST_LEET, COST_MARK, COST_REPEAT, COST_MISREAD, COST_ACCENT = 1.2, 1.6, 0.7, 3.0, 1.0
COST_HYPHEN, COST_NOISE = 0.5, 3.0  # inside a word, a hyphen of a line end and another sign
MOST_COST = 8.0  # of the channel inside one word of run-on text
PRIOR = math.log(1e-5)  # of a word of the vocabulary
MARGIN = 2.0  # by which a word may cost more than free letters
RUN_ON = 16  # tokens of more characters are read as run-on text
OWN_WORD = 0.1  # a misreading this often as frequent as the word is a word of its own

MARKS = "*#_"
DASHES = "—–-"
_HYPHENS = "-¬\xad‐"
_AROUND = ".,;:!?\"'()[]{}«»„“”‘’·•^~<>…`´"
_INNER = frozenset(_AROUND + _HYPHENS + DASHES)
_BETWEEN = re.compile(r"[^\W_][.,;:?!]+[^\W\d_]")
_PUNCTUATION = re.compile(r"([.,;:?!]+)")
_NOISE = str.maketrans(dict.fromkeys("\xad^~|·»«`´"))
# Letters with a digit, sign, mark or dash among them, a letter thrice in a row, or two pairs of letters.
_SUSPECT = re.compile(
    r"(?=.*[^\W\d_])(?:.*[0-9@$€£!|+*#_—–¡¢¥(<-].*|.*([^\W\d_])\1\1.*|.*([^\W\d_])\2[^\W\d_]*([^\W\d_])\3.*)", re.S
).fullmatch
_JOIN = re.compile(r"[-¬\xad‐][ \t]*\r?\n[ \t]*")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]\s+){2,}[^\W_](?!\w)")
_GAP = re.compile(r"\s{2,}|[\n\v\f\r]")
_COLUMN = re.compile(r" {2,}|\t")
_LIGATURES = (("ſ", "s"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
_COMBINING = re.compile("[\u0300-\u036f]+")
_ENDS = re.compile(r"[.!?]['\"»“”)]*$")
STOP, BREAK = ".", "¶"  # in a reading: the end of a sentence, and the end of a run of text

_OPTIONS: dict[str, list[tuple[str, float]]] = {}
for _c in LETTERS:
    _OPTIONS[_c] = [(_c, 0.0)]
for _group in ACCENTS:
    for _c in _group:
        _OPTIONS[_c] += [(o, COST_ACCENT) for o in _group if o != _c and (o == _group[0] or _c == _group[0])]
for _good, _bad in MISREAD:
    if len(_good) == len(_bad) == 1 and _bad in _OPTIONS and all(o != _good for o, _ in _OPTIONS[_bad]):
        _OPTIONS[_bad].append((_good, COST_MISREAD))
for _c, _all in LEET.items():
    _OPTIONS[_c] = [(x, COST_LEET) for x in _all]


def clean(text: str) -> str:
    """Lower case, with ligatures and long s resolved and combining marks dropped."""
    if not text.isascii():
        for ligature, letters in _LIGATURES:
            text = text.replace(ligature, letters)
        text = _COMBINING.sub("", text)
    return text.lower()


def misreadings(words: Iterable[str]) -> dict[str, str]:
    """``{reading: word}`` of one misread letter, of the words of four letters and more."""
    out: dict[str, str] = {}
    for w in sorted(words):
        if len(w) >= 4:
            for good, bad in MISREAD:
                at = w.find(good)
                while at >= 0:
                    out.setdefault(w[:at] + bad + w[at + len(good) :], w)
                    at = w.find(good, at + 1)
    return out


class Statistics:
    """Trigrams of characters and counts of chosen words, of all texts."""

    def __init__(self, trigrams: np.ndarray, words: dict[str, int]):
        counts = trigrams.reshape(_N * _N, _N) + 0.1
        self.model = np.log(counts / counts.sum(axis=1, keepdims=True)).reshape(_N, _N, _N).astype(np.float32)
        self.words = words


def count_trigrams(text: str) -> np.ndarray:
    """Counts of the character trigrams of ``text``, folded to :data:`ALPHABET`."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _FOLD[np.minimum(codes, 0x17F)]
    x[codes >= 0x180] = _N - 1
    if len(x) < 3:
        return np.zeros(_N**3, np.int64)
    return np.bincount((x[:-2] * _N + x[1:-1]) * _N + x[2:], minlength=_N**3)


def statistics(docs: DataFrame, words: Iterable[str], text: str = "text") -> Statistics:
    """Counts over all texts of ``docs``: trigrams, and the ``words`` and their misreadings.

    A task returns a row per trigram and word that occurs in its texts; their number is bounded by
    the alphabet and the vocabulary.
    """
    words = frozenset(words)
    wanted = frozenset(misreadings(words)) | words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(_N**3, np.int64), Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = "\n".join(t for t in batch.column(0).slice(at, 200).to_pylist() if t)
                total += count_trigrams(part)
                seen.update(filter(wanted.__contains__, (t.strip(_AROUND) for t in part.lower().split())))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*map(str, there), *seen], pa.string()), pa.array([*total[there].tolist(), *seen.values()], pa.int64())], ["k", "n"]
        )

    rows = docs.select(docs[text].cast("string")).mapInArrow(run, "k string, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    trigrams, counts = np.zeros(_N**3), {}
    for r in rows.collect():
        if r["k"] in wanted:
            counts[r["k"]] = r["n"]
        else:
            trigrams[int(r["k"])] = r["n"]
    return Statistics(trigrams, counts)


class Trie:
    """A vocabulary as a tree of letters."""

    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.depth = 0
        for w in sorted(words):
            at = 0
            self.depth = max(self.depth, len(w))
            for c in w:
                if c not in self.next[at]:
                    self.next.append({})
                    self.word.append(None)
                    self.next[at][c] = len(self.next) - 1
                at = self.next[at][c]
            self.word[at] = w


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """``(letter it may stand for, cost)`` per character; letter ``?`` for any, ``+`` for one or more."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(token):
        if c in MARKS:
            out.append([("?", COST_MARK)])
        elif c in DASHES:
            if not i or token[i - 1] not in DASHES:
                out.append([("+", COST_MARK)])
        else:
            out.append(_OPTIONS.get(c) or [(c, 0.0)])
    return out


def _stretched(token: str, i: int) -> bool:
    """Whether ``token[i]`` is at least the fourth of equal characters; more of them cost nothing."""
    return i > 2 and token[i] == token[i - 1] == token[i - 2] == token[i - 3]


class Reader:
    """Restores tokens and texts.

    ``charged`` words are restored, ``common`` ones help to read run-on text; the further readings
    of a page are made if they hold one of the charged words ``sought`` (all of them if None).
    """

    CACHE = 200_000

    def __init__(self, statistics: Statistics, charged: Iterable[str], common: Iterable[str], sought: Iterable[str] | None = None):
        self.model = statistics.model.tolist()
        self.charged = frozenset(charged)
        self.sought = self.charged if sought is None else frozenset(sought)
        self.vocabulary = self.charged | frozenset(common)
        self.trie = Trie(w for w in self.charged if len(w) > 2)
        self.words = Trie(w for w in self.vocabulary if len(w) > 2)
        n = statistics.words
        self.misread = {
            bad: w for bad, w in misreadings(self.charged).items()
            if bad not in self.vocabulary and n.get(bad, 0) <= max(2, OWN_WORD * n.get(w, 0))
        }
        # Pieces of charged words, for words into which a space was added.
        self.heads = frozenset(w[:i] for w in self.charged for i in range(1, len(w)))
        self.tails = frozenset(w[i:] for w in self.charged for i in range(1, len(w)))
        self.cache: dict[str, tuple[tuple[str, ...], bool, bool, bool]] = {}
        self.page: dict[str, tuple[tuple[str, ...], bool, bool, bool]] = {}  # long tokens of the page

    # -- one token --------------------------------------------------------------------------------

    def _hidden(self, trie: Trie, node: int, value: float, more: bool, reach) -> None:
        """Steps over hidden letters: one, or with ``more`` any number."""
        front = list(trie.next[node].items())
        for depth in range(trie.depth if more else 1):
            for c, g in front:
                reach(g, c, value + COST_MARK + 0.1 * depth)
            front = [(c, g) for _, child in front for c, g in trie.next[child].items()]
            if not front:
                break

    def best_word(self, steps: list[list[tuple[str, float]]]) -> tuple[str | None, float]:
        """Cheapest path through the charged words: Viterbi over (tree node, last letter)."""
        trie = self.trie
        states: dict[tuple[int, str], float] = {(0, ""): 0.0}
        for step in steps:
            new: dict[tuple[int, str], float] = {}

            def reach(node: int, last: str, value: float) -> None:
                if value < new.get((node, last), math.inf):
                    new[node, last] = value

            for (node, last), value in states.items():
                mark = step[0][0]
                if mark in "?+":
                    self._hidden(trie, node, value, mark == "+", reach)
                    if mark == "+" and node:
                        reach(node, last, value + COST_HYPHEN)
                    continue
                for c, cost in step:
                    child = trie.next[node].get(c)
                    if child is not None:
                        reach(child, c, value + cost)
                    if c == last:
                        reach(node, last, value + cost + COST_REPEAT)
            if not new:
                return None, math.inf
            states = new
        ends = [(value, trie.word[node]) for (node, _), value in states.items() if trie.word[node]]
        if not ends:
            return None, math.inf
        value, word = min(ends)
        return word, value - PRIOR

    def best_letters(self, steps: list[list[tuple[str, float]]]) -> tuple[str, float]:
        """Cheapest path of free letters under the character model, and its cost."""
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for step in steps:
            mark, price = step[0]
            choices = [(c, price) for c in range(1, 27)] if mark in "?+" else [(_SLOT.get(c, _N - 1), v) for c, v in step]
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (value, said) in states.items():
                follow = self.model[a][b]
                for c, cost in choices:
                    v = value + cost - follow[c]
                    if (b, c) not in new or v < new[b, c][0]:
                        new[b, c] = v, said + ALPHABET[c]
                    if b == c and ((a, b) not in new or value + cost + COST_REPEAT < new[a, b][0]):
                        new[a, b] = value + cost + COST_REPEAT, said
            states = new
        value, said = min((value - self.model[a][b][0], said) for (a, b), (value, said) in states.items())
        return said, value

    def restore(self, token: str) -> str:
        """What the lower-case ``token`` most likely says: a charged word, or letters."""
        steps = lattice(token)
        if len(steps) < 3 or sum(s[0][0] in "?+" for s in steps) > len(steps) - 2:
            return token
        word, cost = self.best_word(steps)
        if word is None and (any(x[0][0] in "?+" for x in steps) or 2 * sum(c.isalpha() for c in token) <= len(token) or not any(c in LEET for c in token)):
            return token  # letters that are hidden, an amount, a number, a compound or a rare word
        letters, free = self.best_letters(steps)
        return word if word is not None and cost <= free + MARGIN else letters.replace("#", "")

    def read(self, token: str) -> tuple[str, ...]:
        """The words that the lower-case ``token`` says, as printed or restored."""
        if token in self.vocabulary:
            return (token,)
        bare = token.strip(_AROUND)
        plain = bare.isalpha()
        if not plain:
            bare = bare.translate(_NOISE)
        if bare in self.vocabulary:
            return (bare,)
        if not bare:
            return ()
        if bare in self.misread:
            return (self.misread[bare],)
        if len(bare) > RUN_ON:
            return tuple(self.segment(token))
        if not plain and _BETWEEN.search(bare):
            parts = _PUNCTUATION.split(bare)  # words, and signs between them
            words = parts[0::2]
            if "".join(words) not in self.charged and all(p.isalpha() and (len(p) > 3 or p in self.vocabulary) for p in words):
                said = list(self.read(words[0]))
                for sign, word in zip(parts[1::2], words[1:]):
                    said += [STOP, *self.read(word)] if any(c in ".!?" for c in sign) else self.read(word)
                return tuple(said)
            return tuple(self.segment(token))
        if len(bare) > 6 and (parts := self._two(bare)) is not None:
            return parts
        if len(bare) >= 3 and _SUSPECT(bare):
            return (self.restore(bare),)
        return (bare,)

    def _entry(self, token: str) -> tuple[tuple[str, ...], bool, bool, bool]:
        """What :meth:`read` says, whether it may end or begin a charged word, and whether a sentence ends."""
        if token in self.page:
            return self.page[token]
        words = self.read(token)
        one = len(words) == 1
        stop = token[-1] in ".!?\"'»“”)" and len(token) > 3 and _ENDS.search(token) is not None
        made = words, one and words[0] in self.tails, one and words[0] in self.heads and not stop, stop
        if len(token) > 2 * RUN_ON:
            self.page[token] = made
        else:
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[token] = made
        return made

    def _two(self, token: str) -> tuple[str, str] | None:
        """Two words between which the space was lost, one of them charged."""
        for i in range(2, len(token) - 1):
            a, b = token[:i], token[i:]
            if a in self.vocabulary and b in self.vocabulary and (
                (a in self.charged and len(a) > 3 and len(b) > 1) or (b in self.charged and len(b) > 3)
            ):
                return a, b
        return None

    # -- run-on text ------------------------------------------------------------------------------

    def _arcs(self, token: str, steps: list[list[tuple[str, float]]], start: int) -> dict[tuple[int, str], float]:
        """``{(end, word): cost}`` of the words that may begin at ``start`` of run-on text."""
        out: dict[tuple[int, str], float] = {}
        states: dict[tuple[int, str], float] = {(0, ""): 0.0}
        following = self.words.next
        for i in range(start, len(token)):
            new: dict[tuple[int, str], float] = {}

            def reach(node: int, last: str, value: float) -> None:
                if value <= MOST_COST and value < new.get((node, last), math.inf):
                    new[node, last] = value

            step = steps[i]
            for (node, last), value in states.items():
                if node and token[i] in _INNER:
                    reach(node, last, value + (COST_HYPHEN if token[i] in _HYPHENS else COST_NOISE))
                mark = step[0][0] if step else ""
                if mark and mark in "?+":
                    self._hidden(self.words, node, value, mark == "+", reach)
                    continue
                for c, cost in step:
                    child = following[node].get(c)
                    if child is not None:
                        reach(child, c, value + cost)
                    if c == last:
                        reach(node, last, value + (0.0 if _stretched(token, i) else cost + COST_REPEAT))
            if not new:
                break
            states = new
            if token[i] in _INNER:  # the word has ended before
                continue
            for (node, _), value in states.items():
                word = self.words.word[node]
                if word and value < out.get((i + 1, word), math.inf):
                    out[i + 1, word] = value
        return out

    def segment(self, token: str) -> list[str]:
        """The words of run-on text.

        Viterbi over the last two characters: the next is a letter, a letter after a lost space,
        punctuation, or a whole word of the vocabulary.
        """
        model, other = self.model, _N - 1
        steps = [[] if c in _INNER and c not in LEET and c not in DASHES[:2] else lattice(c)[0] for c in token]
        # Per position, {last two characters: (cost, where from, word or None for a character, opens a word)}.
        best: list[dict[tuple[int, int], tuple[float, tuple | None, str | None, bool]]] = [{} for _ in range(len(token) + 1)]
        best[0][0, 0] = (0.0, None, None, True)

        def reach(at: int, state: tuple[int, int], value: float, origin: tuple, word: str | None, opens: bool) -> None:
            if state not in best[at] or value < best[at][state][0]:
                best[at][state] = (value, origin, word, opens)

        for i, c in enumerate(token):
            slot = _SLOT.get(c, other)
            edge, edge_from = math.inf, None  # cheapest way to be between words here
            for state, (value, *_) in best[i].items():
                a, b = state
                origin = (i, state)
                gap = 0.0 if b == 0 else -model[a][b][0]
                if value + gap < edge:
                    edge, edge_from = value + gap, origin
                if c in _INNER:
                    reach(i + 1, (other, 0), value + (0.0 if b == 0 else -model[a][b][other] - model[b][other][0]), origin, STOP if c in ".!?" else "", True)
                    if c in _HYPHENS and b:
                        reach(i + 1, state, value + COST_HYPHEN, origin, None, False)
                    if c not in LEET:
                        continue
                reach(i + 1, (b, slot), value - model[a][b][slot], origin, None, b == 0)
                if b:
                    reach(i + 1, (0, slot), value + gap - model[b][0][slot], origin, None, True)
                if slot == b:
                    reach(i + 1, state, value + (0.0 if _stretched(token, i) else COST_REPEAT), origin, None, False)
            if edge_from is not None and not _stretched(token, i):
                for (end, word), cost in self._arcs(token, steps, i).items():
                    reach(end, (_SLOT.get(word[-1], other), 0), edge + cost - PRIOR - MARGIN, edge_from, word, True)
        state = min(best[-1], key=lambda s: best[-1][s][0] + (0.0 if s[1] == 0 else -model[s[0]][s[1]][0]))
        out: list[str] = []
        at, end = len(token), len(token)
        while at:
            _, (before, prior), word, opens = best[at][state]
            if word is not None or opens:
                rest = token[at if word is not None else before : end].strip(_AROUND)
                if rest:
                    out.append(self.misread.get(rest, rest) if len(rest) < 3 or not _SUSPECT(rest) else self.restore(rest))
                if word:
                    out.append(word)
                end = before
            at, state = before, prior
        return out[::-1]

    def spaced(self, run: str) -> list[str]:
        """The words of a run of single characters: joined over all gaps, or over single blanks if that reads more."""
        joined = self.segment("".join(run.split()))
        parts = [w for part in _GAP.split(run) for w in self.segment("".join(part.split()))]
        told = lambda words: sum(len(w) for w in words if w in self.charged)
        if told(parts) > told(joined):
            joined = parts
        return joined if told(joined) else run.split()

    # -- texts ------------------------------------------------------------------------------------

    def words_of(self, text: str) -> list[str]:
        """The restored words of cleaned ``text``, with :data:`STOP` after sentences."""
        text = _JOIN.sub("", text)
        out: list[str] = []
        at = 0
        for m in _SPACED.finditer(text):
            self._said(text[at : m.start()].split(), out)
            out += self.spaced(m.group(0))
            at = m.end()
        self._said(text[at:].split(), out)
        return out

    def _said(self, tokens: Iterable[str], out: list[str]) -> None:
        get, before = self.cache.get, ""
        for t in tokens:
            words, tail, head, stop = get(t) or self._entry(t)
            if tail and before and before + words[0] in self.charged and not (before in self.vocabulary and words[0] in self.vocabulary):
                out[-1] = before + words[0]  # a space was added
            else:
                out += words
            before = words[0] if head else ""
            if stop and out and out[-1] != STOP:
                out.append(STOP)

    def _says(self, token: str) -> bool:
        """Whether ``token`` says a sought word."""
        words = (self.cache.get(token) or self._entry(token))[0]
        return not self.sought.isdisjoint(words)

    @staticmethod
    def _across(pieces: list[list[str]]) -> list[list[str]]:
        """The tokens of pieces of lines, words broken at line ends joined; longer than a word is none."""
        out: list[list[str]] = []
        for piece in pieces:
            if piece and out and out[-1] and out[-1][-1][-1] in _HYPHENS and 0 < len(out[-1][-1]) + len(piece[0]) - 1 <= RUN_ON:
                out[-1][-1] = out[-1][-1][:-1] + piece[0]
                piece = piece[1:]
            out.append(list(piece))
        return out

    def readings(self, text: str | None) -> list[str]:
        """The restored words of a page, then of its alternate lines and of its columns.

        Columns beside each other in one line are told by wide gaps, however many there are.  The
        further readings are made if the first, or a word broken at a line end in one of them, holds
        a sought word; :data:`BREAK` stands before each.
        """
        if not text:
            return []
        self.page.clear()
        text = clean(text)
        out = self.words_of(text)
        lines = text.split("\n")
        further: list[list[list[str]]] = []
        if len(lines) > 2:
            rows = [line.split() for line in lines]
            further += [rows[0::2], rows[1::2]]
        if _COLUMN.search(text):
            cells = [[c.split() for c in _COLUMN.split(line.strip())] for line in lines]
            columns = max(map(len, cells))
            if columns > 1:
                further += [[row[j] for row in cells if len(row) > j] for j in range(columns)]
        wanted = not self.sought.isdisjoint(out)
        if not wanted:
            for pieces in further:
                broken = (a[-1][:-1] + b[0] for a, b in zip(pieces, pieces[1:]) if a and b and a[-1][-1] in _HYPHENS)
                if any(self._says(t) for t in broken if 0 < len(t) <= RUN_ON):
                    wanted = True
                    break
        if wanted:
            for pieces in further:
                out.append(BREAK)
                for piece in self._across(pieces):
                    self._said(piece, out)
        return out


def restored(docs: DataFrame, reader_of, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, text)`` with every text restored, its words joined by one space; null for a null text.

    ``reader_of`` makes the :class:`Reader` in a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = reader_of()
        for batch in batches:
            made = [None if t is None else " ".join(reader.words_of(clean(t))).replace(" " + STOP, STOP) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, docs[text].cast("string").alias("_text")).mapInArrow(run, f"{key} {kind}, text string")
