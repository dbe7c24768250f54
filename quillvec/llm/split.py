"""Splitting oversized texts at natural boundaries (problem 1).

Per text: token offsets as sorted arrays, prefix sums of tokens over the lines, and one sorted
boundary array per kind of boundary (paragraph, sentence, line).  A piece starts at token ``s`` and
may end at ``s + window`` at most; its end is found by binary search as the last boundary under
that limit, and the next piece starts ``overlap`` tokens before the end.  Where no boundary is in
reach the cut is hard, at the limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from quillvec.session import small

BLANKS = " \t\n\v\f\r"  # the separators of tokens
WHOLE, PARAGRAPH, SENTENCE, LINE, HARD = "whole", "paragraph", "sentence", "line", "hard"
_SENTENCE_END = np.array([ord(c) for c in ".!?;"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’»"], np.uint32)
_BROKEN_END = np.array([ord(c) for c in "-¬­‐"], np.uint32)
_IS_BLANK = np.zeros(33, bool)
_IS_BLANK[[ord(c) for c in BLANKS]] = True

FLUSH_CHARS = 8_000_000  # characters of pieces that are handed over at once


@dataclass
class Layout:
    """Token and boundary arrays of one text."""

    starts: np.ndarray  # first character of each token
    ends: np.ndarray  # character after each token
    para_first: np.ndarray  # first token of each paragraph
    para_last: np.ndarray  # token after each paragraph
    boundaries: tuple[tuple[str, np.ndarray], ...]  # by kind, sorted token positions to cut before


def layout(text: str) -> Layout:
    """Offsets, prefix sums over lines, and boundary arrays of ``text``."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _IS_BLANK[np.minimum(chars, 32)] & (chars <= 32)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    # Prefix sums: tokens before each line, then the lines that hold tokens.
    lines = np.concatenate((np.searchsorted(starts, np.flatnonzero(chars == 10)), [len(starts)]))
    per_line = np.diff(np.concatenate(([0], lines)))
    before = lines - per_line
    full = per_line > 0
    opens = full & ~np.concatenate(([False], full[:-1]))
    closes = full & ~np.concatenate((full[1:], [False]))
    para_first, para_last = before[opens], lines[closes]
    if len(starts):
        last = chars[ends - 1]
        inner = chars[np.maximum(ends - 2, starts)]
        stops = np.isin(last, _SENTENCE_END) | (np.isin(last, _CLOSERS) & np.isin(inner, _SENTENCE_END))
        sentence = np.flatnonzero(stops) + 1
        line_ends = lines[full]
        line_ends = line_ends[~np.isin(last[line_ends - 1], _BROKEN_END)]
    else:
        sentence = line_ends = np.zeros(0, np.int64)
    return Layout(
        starts, ends, para_first, para_last, ((PARAGRAPH, para_last), (SENTENCE, sentence), (LINE, line_ends))
    )


def settings(window: int | None, overlap: int | None) -> tuple[int, int]:
    """Window and overlap that hold: 0 or less is a window of 1, a null window 64; an overlap not
    below the window is window - 1; a null or negative overlap is none."""
    w = 64 if window is None else max(1, window)
    return w, min(max(0, overlap or 0), w - 1)


def cuts(at: Layout, window: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces ``(first token, token after, kind of cut)``, each of at most ``window`` tokens.

    The strongest kind of boundary in the upper half of the window wins (paragraph, sentence,
    line); failing that, the last boundary of any kind that makes progress; failing that, a hard cut.
    """
    n, out, start = len(at.starts), [], 0
    while n:
        limit = start + window
        if limit >= n:
            out.append((start, n, WHOLE if not out else PARAGRAPH))
            break
        floor = start + overlap  # an end up to here would not get on
        half = max(floor, start + window // 2)
        end, kind, weak, weak_kind = 0, HARD, 0, HARD
        for name, positions in at.boundaries:
            i = int(np.searchsorted(positions, limit, side="right"))
            found = int(positions[i - 1]) if i else 0
            if found > half:
                end, kind = found, name
                break
            if found > floor and found > weak:
                weak, weak_kind = found, name
        if not end:
            end, kind = (weak, weak_kind) if weak else (limit, HARD)
        out.append((start, end, kind))
        start = end - overlap
    return out


_PIECE = StructType(
    [
        StructField("piece_no", IntegerType()),
        StructField("start_token", IntegerType()),
        StructField("end_token", IntegerType()),
        StructField("cut", StringType()),
        StructField("text", StringType()),
    ]
)


def with_settings(docs: DataFrame, config: DataFrame, key: Column, text: Column, source: Column) -> DataFrame:
    """``(key, text, window, overlap)``; a source without a row, or null, gets the row ``*``.

    Of several rows for one source, the one with the least ``config_id`` holds.  Without a row
    ``*`` the defaults of :func:`settings` hold.
    """
    one = config.groupBy(F.col("source").alias("_source")).agg(
        F.min_by(F.struct("window_size", "overlap_size"), "config_id").alias("_own")
    )
    star = one.where(F.col("_source") == "*").agg(F.first("_own").alias("_star"))
    wanted = docs.select(key.alias("_key"), text.cast("string").alias("_text"), source.alias("_src"))
    joined = wanted.join(small(one), F.col("_src") == F.col("_source"), "left").crossJoin(F.broadcast(star))
    # A row of its own holds even if its fields are null.
    held = F.when(F.col("_source").isNotNull(), F.col("_own")).otherwise(F.col("_star"))
    return joined.select(
        "_key", "_text", held["window_size"].alias("_window"), held["overlap_size"].alias("_overlap")
    )


def split_texts(
    docs: DataFrame, config: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """Pieces of every text, and the paragraphs that had to be cut inside.

    Returns ``(key, kind, para_no, piece_no, start_token, end_token, cut, text)``.  Rows of kind
    ``piece`` are the pieces; a text within its window is one piece, a null, empty or blank text
    none.  Rows of kind ``oversized`` name the paragraphs with more tokens than the window.  The
    text of a piece is the unchanged stretch of the original.  Repeated rows and null keys are split
    like any other; other columns are ignored.  One narrow pass, no shuffle: a long text is one
    row of its task, handed on in bounded batches.
    """
    rows = with_settings(docs, config, docs[key], docs[text], docs[source])
    schema = StructType(
        [
            StructField(key, docs.schema[key].dataType),
            StructField("kind", StringType(), False),
            StructField("para_no", IntegerType()),
            *_PIECE.fields,
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = batch.column(0), 0
            at: list[int] = []
            cols: list[list] = [[] for _ in range(7)]

            def flush() -> pa.RecordBatch:
                kinds = [pa.string(), *[pa.int32()] * 4, pa.string(), pa.string()]
                made = [keys.take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(cols, kinds))]
                return pa.RecordBatch.from_arrays(made, schema.names)

            texts, windows, overlaps = (batch.column(i) for i in (1, 2, 3))
            for row in range(len(keys)):
                body = texts[row].as_py()
                if not body:
                    continue
                window, overlap = settings(windows[row].as_py(), overlaps[row].as_py())
                where = layout(body)
                for p in np.flatnonzero(where.para_last - where.para_first > window).tolist():
                    at.append(row)
                    for c, v in zip(cols, ("oversized", p, None, None, None, None, None)):
                        c.append(v)
                for k, (s, e, kind) in enumerate(cuts(where, window, overlap)):
                    piece = body[where.starts[s] : where.ends[e - 1]]
                    held += len(piece)
                    at.append(row)
                    for c, v in zip(cols, ("piece", None, k, s, e, kind, piece)):
                        c.append(v)
                    if held > FLUSH_CHARS:
                        yield flush()
                        at.clear()
                        for c in cols:
                            c.clear()
                        held = 0
            yield flush()

    return rows.mapInArrow(run, schema)


def oversized_paragraphs(docs: DataFrame, config: DataFrame) -> DataFrame:
    """``(doc_id, para_no)`` of the paragraphs that the splitter has to cut inside."""
    return split_texts(docs, config).where(F.col("kind") == "oversized").select("doc_id", F.col("para_no"))


def pieces(docs: DataFrame, config: DataFrame) -> DataFrame:
    """``(doc_id, piece_no, start_token, end_token, cut, text)`` of every text."""
    return (
        split_texts(docs, config)
        .where(F.col("kind") == "piece")
        .select("doc_id", "piece_no", "start_token", "end_token", "cut", "text")
    )
