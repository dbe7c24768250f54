"""Vectors and metadata from JSON text."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec.functions.filters import meta_map
from quillvec.operators.oplog import META

_VALUE = pa.struct([("t", pa.int8()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("b", pa.bool_())])
_MAP = pa.map_(pa.string(), _VALUE)
_LONG = range(-(2**63), 2**63)


def vector(text: Column) -> Column:
    """``array<float>`` of a JSON array of numbers; null where the text is none."""
    return F.from_json(text, "array<float>")


def _parsed(text: str | None) -> list | None:
    if text is None:
        return None
    try:
        pairs = meta_map(json.loads(text))
    except ValueError:
        return []
    # An integer beyond 64 bits is kept as a double.
    fits = lambda v: v if v["i"] is None or v["i"] in _LONG else v | {"t": 1, "i": None, "d": float(v["i"])}
    return [(k, fits(v)) for k, v in pairs.items()]


def metadata(text: Column) -> Column:
    """Metadata map of a JSON object.

    Strings, booleans, integers and other numbers keep their kind; nested values and null become
    their JSON text.  Anything that is no object, or no JSON, is an empty map; null stays null.
    """

    @F.arrow_udf(META)
    def run(text: pa.Array) -> pa.Array:
        return pa.array([_parsed(t) for t in text.to_pylist()], _MAP)

    return run(text)
