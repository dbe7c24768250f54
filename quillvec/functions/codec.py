"""Byte format of operations and log records, for import and export.

Little endian.  An operation is: u8 kind (1 Insert, 2 Update, 3 Delete); u32 length and the id;
unless Delete: u32 dim and the f32 elements, u8 whether metadata follow, and then u32 count and per
entry u32 length and key, u8 type (0 i64, 1 f64, 2 string, 3 bool as one byte) and the value.
A log record is u32 CRC-32 of the payload, u32 its length, the payload; a snapshot record has no CRC.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillvec.functions.filters import BOOL, DOUBLE, INT, STRING
from quillvec.operators.oplog import DELETE, META

_TYPE = {INT: 0, DOUBLE: 1, STRING: 2, BOOL: 3}
_TAG = {v: k for k, v in _TYPE.items()}

OP_STRUCT = f"op int, ext_id string, vec array<float>, meta {META}"


class CorruptRecord(ValueError):
    """Bytes that are no operation."""


def _text(value: str) -> bytes:
    data = value.encode("utf-8")
    return struct.pack("<I", len(data)) + data


def encode(op: int, ext_id: str, vec: Any, meta: dict[str, Any] | None) -> bytes:
    """The bytes of an operation; ``meta`` maps keys to tagged values, None leaves it unset."""
    out = [struct.pack("<B", op), _text(ext_id)]
    if op != DELETE:
        elements = np.asarray([] if vec is None else vec, "<f4")
        out += [struct.pack("<I", len(elements)), elements.tobytes(), struct.pack("<B", meta is not None)]
        if meta is not None:
            out.append(struct.pack("<I", len(meta)))
            for key, v in meta.items():
                t = v["t"]
                out += [_text(key), struct.pack("<B", _TYPE[t])]
                if t == INT:
                    out.append(struct.pack("<q", v["i"]))
                elif t == DOUBLE:
                    out.append(struct.pack("<d", v["d"]))
                elif t == STRING:
                    out.append(_text(v["s"]))
                else:
                    out.append(struct.pack("<B", bool(v["b"])))
    return b"".join(out)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CorruptRecord("the record ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> Any:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))[0]

    def text(self) -> str:
        return self.take(self.number("I")).decode("utf-8")


def decode(data: bytes) -> dict[str, Any]:
    """The operation of some bytes; raises :class:`CorruptRecord` if they are none."""
    b = _Bytes(data)
    op = b.number("B")
    if op not in (1, 2, 3):
        raise CorruptRecord(f"unknown operation {op}")
    out: dict[str, Any] = {"op": op, "ext_id": b.text(), "vec": None, "meta": None}
    if op == DELETE:
        return out
    dim = b.number("I")
    out["vec"] = np.frombuffer(b.take(4 * dim), "<f4").tolist()
    if b.number("B"):
        meta = {}
        for _ in range(b.number("I")):
            key, kind = b.text(), b.number("B")
            value: dict[str, Any] = {"t": None, "i": None, "d": None, "s": None, "b": None}
            if kind not in _TAG:
                raise CorruptRecord(f"unknown value type {kind}")
            value["t"] = _TAG[kind]
            if kind == 0:
                value["i"] = b.number("q")
            elif kind == 1:
                value["d"] = b.number("d")
            elif kind == 2:
                value["s"] = b.text()
            else:
                value["b"] = bool(b.number("B"))
            meta[key] = value
        out["meta"] = meta
    return out


def frame(payload: bytes) -> bytes:
    """A log record."""
    return struct.pack("<II", zlib.crc32(payload), len(payload)) + payload


def frames(data: bytes) -> Iterator[bytes]:
    """Payloads of a log in order, up to the first record that is short or fails its CRC."""
    at = 0
    while at + 8 <= len(data):
        crc, n = struct.unpack_from("<II", data, at)
        payload = data[at + 8 : at + 8 + n]
        if len(payload) < n or zlib.crc32(payload) != crc:
            return
        yield payload
        at += 8 + n


def plain_frames(data: bytes) -> Iterator[bytes]:
    """Payloads of a snapshot, up to the first that is short."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            return
        yield data[at + 4 : at + 4 + n]
        at += 4 + n


def encode_op(op: Column, ext_id: Column, vec: Column, meta: Column) -> Column:
    """Binary column of operations; null where the kind or the id is null."""

    @F.arrow_udf("binary")
    def run(op: pa.Array, ext_id: pa.Array, vec: pa.Array, meta: pa.Array) -> pa.Array:
        rows = zip(op.to_pylist(), ext_id.to_pylist(), vec.to_pylist(), meta.to_pylist())
        made = [None if o is None or i is None else encode(o, i, v, None if m is None else dict(m)) for o, i, v, m in rows]
        return pa.array(made, pa.binary())

    return run(op, ext_id, vec, meta)


def decode_op(data: Column) -> Column:
    """Struct of the operation; where the bytes are none its fields are null and ``_corrupt`` says why."""

    @F.arrow_udf(f"{OP_STRUCT}, _corrupt string")
    def run(data: pa.Array) -> pa.Array:
        value = pa.struct([("t", pa.int8()), ("i", pa.int64()), ("d", pa.float64()), ("s", pa.string()), ("b", pa.bool_())])
        kind = pa.struct(
            [("op", pa.int32()), ("ext_id", pa.string()), ("vec", pa.list_(pa.float32())),
             ("meta", pa.map_(pa.string(), value)), ("_corrupt", pa.string())]
        )
        empty = {"op": None, "ext_id": None, "vec": None, "meta": None, "_corrupt": None}
        rows = []
        for d in data.to_pylist():
            try:
                row = empty if d is None else empty | decode(d)
            except (CorruptRecord, UnicodeDecodeError) as e:
                row = empty | {"_corrupt": str(e)}
            rows.append(row if row["meta"] is None else row | {"meta": list(row["meta"].items())})
        return pa.array(rows, kind)

    return run(data)
