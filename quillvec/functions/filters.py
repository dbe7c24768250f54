"""Metadata predicates: a small expression tree, compiled to a two-valued column.

A leaf is false where its key is missing, or where the stored value and the literal cannot be
compared (a string with a number, a boolean with anything else); this holds for ``ne`` too, so
``ne`` is not the negation of ``eq``.  Leaves are never null, and so the tree is two-valued.

Integers compare with integers exactly, and as doubles with doubles.  Strings compare bytewise.
False is less than true.  NaN equals only NaN and is greater than any number, as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any, Union

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Value = Union[int, float, str, bool]

INT, DOUBLE, STRING, BOOL = 0, 1, 2, 3  # tags of a stored value


@dataclass(frozen=True)
class Compare:
    op: str  # eq ne lt le gt ge
    key: str
    value: Value


@dataclass(frozen=True)
class In:
    key: str
    values: tuple[Value, ...]


@dataclass(frozen=True)
class AllOf:
    children: tuple["Filter", ...]


@dataclass(frozen=True)
class AnyOf:
    children: tuple["Filter", ...]


@dataclass(frozen=True)
class Negate:
    child: "Filter"


Filter = Union[Compare, In, AllOf, AnyOf, Negate]


def eq(key: str, value: Value) -> Filter:
    return Compare("eq", key, value)


def ne(key: str, value: Value) -> Filter:
    return Compare("ne", key, value)


def lt(key: str, value: Value) -> Filter:
    return Compare("lt", key, value)


def le(key: str, value: Value) -> Filter:
    return Compare("le", key, value)


def gt(key: str, value: Value) -> Filter:
    return Compare("gt", key, value)


def ge(key: str, value: Value) -> Filter:
    return Compare("ge", key, value)


def is_in(key: str, values: Iterable[Value]) -> Filter:
    """True where the value equals one of ``values``; an empty list is false."""
    return In(key, tuple(values))


def all_of(*children: Filter) -> Filter:
    """Conjunction; without children true."""
    return AllOf(children)


def any_of(*children: Filter) -> Filter:
    """Disjunction; without children false."""
    return AnyOf(children)


def negate(child: Filter) -> Filter:
    """Two-valued negation: true where the child's key is missing."""
    return Negate(child)


def from_json(pairs: Any) -> Filter | None:
    """Conjunction of equalities of a JSON object; None (no filter) if it is empty or no object."""
    if not isinstance(pairs, Mapping) or not pairs:
        return None
    return all_of(*(eq(str(k), v) for k, v in pairs.items()))


_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def _tag(value: Value) -> int:
    if isinstance(value, bool):
        return BOOL
    if isinstance(value, int):
        return INT
    if isinstance(value, float):
        return DOUBLE
    if isinstance(value, str):
        return STRING
    raise TypeError(f"no metadata value: {value!r}")


def _on_struct(op: str, stored: Column, value: Value) -> Column:
    """Comparison with a tagged struct; null where it does not apply."""
    compare, tag = _OPS[op], _tag(value)
    t = stored["t"]
    if tag == BOOL:
        return F.when(t == BOOL, compare(stored["b"], F.lit(value)))
    if tag == STRING:
        return F.when(t == STRING, compare(stored["s"], F.lit(value)))
    as_double = F.lit(float(value))
    if tag == INT:
        return F.when(t == INT, compare(stored["i"], F.lit(value).cast("bigint"))).when(
            t == DOUBLE, compare(stored["d"], as_double)
        )
    return F.when(t == INT, compare(stored["i"].cast("double"), as_double)).when(
        t == DOUBLE, compare(stored["d"], as_double)
    )


def _on_promoted(op: str, stored: Column, value: Value) -> Column:
    """Comparison with a promoted tagged struct, of plain comparisons of its fields that reach the scan.

    Null only where the struct is null.
    """
    compare, tag = _OPS[op], _tag(value)
    one = lambda t, field, v: (stored["t"] == F.lit(t)) & compare(stored[field], v)
    if tag == BOOL:
        return one(BOOL, "b", F.lit(value))
    if tag == STRING:
        return one(STRING, "s", F.lit(value))
    if tag == INT:
        return one(INT, "i", F.lit(value).cast("bigint")) | one(DOUBLE, "d", F.lit(float(value)))
    return ((stored["t"] == F.lit(INT)) & compare(stored["i"].cast("double"), F.lit(value))) | one(DOUBLE, "d", F.lit(value))


_NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _on_typed(op: str, column: Column, kind: str, value: Value) -> Column | None:
    """Comparison with a promoted, typed column; None where the types cannot be compared.

    Plain comparisons of a column with a literal are pushed down to Parquet.
    """
    compare, tag = _OPS[op], _tag(value)
    if kind == "boolean":
        return compare(column, F.lit(value)) if tag == BOOL else None
    if kind == "string":
        return compare(column, F.lit(value)) if tag == STRING else None
    if kind in _NUMBERS or kind.startswith("decimal"):
        return compare(column, F.lit(value)) if tag in (INT, DOUBLE) else None
    return None


class Compiler:
    """Compiles filters for a table.

    ``promoted`` maps metadata keys to columns of the table, typed or tagged structs; other keys are looked up in the
    map column ``meta``, if the table has one.
    """

    def __init__(self, df: DataFrame, meta: str | None = "meta", promoted: Mapping[str, str] | None = None):
        self.df = df
        self.meta = meta if meta in df.columns else None
        self.promoted = dict(promoted or {})
        self.kinds = dict(df.dtypes)

    def _raw(self, op: str, key: str, value: Value) -> Column | None:
        """The comparison, null where the key is missing; None if it can never hold."""
        if key in self.promoted:
            name = self.promoted[key]
            if self.kinds[name].startswith("struct<t:"):
                return _on_promoted(op, self.df[name], value)
            return _on_typed(op, self.df[name], self.kinds[name], value)
        if self.meta:
            return _on_struct(op, F.try_element_at(self.df[self.meta], F.lit(key)), value)
        return None

    def _leaf(self, op: str, key: str, value: Value) -> Column:
        made = self._raw(op, key, value)
        return F.lit(False) if made is None else F.coalesce(made, F.lit(False))

    def predicate(self, f: Filter | None, holds: bool = True) -> Column:
        """Condition for ``where`` that keeps the rows for which ``f`` is (or, not ``holds``, is not) true.

        It may be null where it does not hold.  Negations are moved down to the leaves and typed
        columns are compared bare, so that the condition can be pushed down to the scan.
        """
        if f is None:
            return F.lit(holds)
        if isinstance(f, Negate):
            return self.predicate(f.child, not holds)
        if isinstance(f, In):
            return self.predicate(AnyOf(tuple(Compare("eq", f.key, v) for v in f.values)), holds)
        if isinstance(f, (AllOf, AnyOf)):
            both = isinstance(f, AllOf) == holds
            parts = (self.predicate(c, holds) for c in f.children)
            return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), parts, F.lit(both))
        made = self._raw(f.op, f.key, f.value)
        if made is None:
            return F.lit(not holds)
        if holds:
            return made
        if f.key in self.promoted:
            if self.kinds[self.promoted[f.key]].startswith("struct<t:"):
                return ~F.coalesce(made, F.lit(False))
            return ~made | self.df[self.promoted[f.key]].isNull()
        return ~F.coalesce(made, F.lit(False))

    def column(self, f: Filter | None) -> Column:
        """The filter as a boolean column that is never null; None is true."""
        if f is None:
            return F.lit(True)
        if isinstance(f, Compare):
            return self._leaf(f.op, f.key, f.value)
        if isinstance(f, In):
            return self.column(AnyOf(tuple(Compare("eq", f.key, v) for v in f.values)))
        if isinstance(f, AllOf):
            return reduce(lambda a, b: a & b, (self.column(c) for c in f.children), F.lit(True))
        if isinstance(f, AnyOf):
            return reduce(lambda a, b: a | b, (self.column(c) for c in f.children), F.lit(False))
        if isinstance(f, Negate):
            return ~self.column(f.child)
        raise TypeError(f"no filter: {f!r}")


def where(df: DataFrame, f: Filter | None, meta: str | None = "meta", promoted: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of ``df`` that pass ``f``."""
    return df if f is None else df.where(Compiler(df, meta, promoted).predicate(f))


def meta_value(value: Any) -> dict[str, Any]:
    """A JSON value as a tagged struct: anything but string, boolean and number as its JSON text."""
    import json

    empty = {"t": STRING, "i": None, "d": None, "s": None, "b": None}
    if isinstance(value, bool):
        return empty | {"t": BOOL, "b": value}
    if isinstance(value, int):
        return empty | {"t": INT, "i": value}
    if isinstance(value, float):
        return empty | {"t": DOUBLE, "d": value}
    if isinstance(value, str):
        return empty | {"s": value}
    return empty | {"s": json.dumps(value, separators=(",", ":"), ensure_ascii=False)}


def meta_map(pairs: Any) -> dict[str, dict[str, Any]]:
    """A JSON object as a metadata map; anything else is an empty map."""
    return {str(k): meta_value(v) for k, v in pairs.items()} if isinstance(pairs, Mapping) else {}
