"""Schema inference over Python rows: fields in order of first appearance, and types that widen or refuse to mix.

A shape is a small mergeable value, so each task can infer its own rows and shapes merge in the order of the rows. Rules: a
float among numbers gives double, an int (with or without bools) bigint, bools alone boolean; strings mix with nothing but
null; lists and structs neither; a column of nulls is a string; a column of empty lists an array of strings; a missing key
is null; tuples are lists."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

_LONG = 1 << 63


@dataclass
class Shape:
    kinds: set[str] = field(default_factory=set)  # bool, int, float, str, list, struct
    item: Shape | None = None
    fields: dict[str, Shape] = field(default_factory=dict)

    def see(self, value: Any) -> Shape:
        if value is None:
            return self
        if isinstance(value, bool):
            self.kinds.add("bool")
        elif isinstance(value, int):
            if not -_LONG <= value < _LONG:
                raise OverflowError(f"{value} doesn't fit 64 bits")
            self.kinds.add("int")
        elif isinstance(value, float):
            self.kinds.add("float")
        elif isinstance(value, str):
            self.kinds.add("str")
        elif isinstance(value, (list, tuple)):
            self.kinds.add("list")
            self.item = self.item or Shape()
            for x in value:
                self.item.see(x)
        elif isinstance(value, dict):
            self.kinds.add("struct")
            for k, x in value.items():
                if not isinstance(k, str):
                    raise TypeError(f"keys are strings, not {k!r}")
                self.fields.setdefault(k, Shape()).see(x)
        else:
            raise TypeError(f"no column type for {type(value).__name__}")
        return self

    def merge(self, later: Shape) -> Shape:
        """self, widened by a shape of later rows."""
        self.kinds |= later.kinds
        if later.item is not None:
            self.item = self.item.merge(later.item) if self.item else later.item
        for k, x in later.fields.items():
            self.fields[k] = self.fields[k].merge(x) if k in self.fields else x
        return self

    def type(self, name: str = "value") -> T.DataType:
        if not self.kinds:
            return T.StringType()
        if "list" in self.kinds:
            if len(self.kinds) > 1:
                raise TypeError(f"{name}: lists mixed with other values")
            return T.ArrayType(self.item.type(f"{name}[]"))
        if "struct" in self.kinds:
            if len(self.kinds) > 1:
                raise TypeError(f"{name}: structs mixed with other values")
            if not self.fields:
                raise ValueError(f"{name}: a struct column needs at least one field")
            return T.StructType([T.StructField(k, x.type(f"{name}.{k}")) for k, x in self.fields.items()])
        if "str" in self.kinds:
            if len(self.kinds) > 1:
                raise TypeError(f"{name}: strings mixed with other values")
            return T.StringType()
        return T.DoubleType() if "float" in self.kinds else T.LongType() if "int" in self.kinds else T.BooleanType()

    def row_type(self) -> T.StructType:
        """The schema of rows; empty if no row has a key."""
        if self.kinds - {"struct"}:
            raise TypeError("rows are dicts or null")
        return self.type("row") if self.fields else T.StructType([])

    def mixes_bool(self) -> bool:
        """Whether a column somewhere holds both bools and numbers, which JSON readers don't convert."""
        own = "bool" in self.kinds and bool(self.kinds & {"int", "float"})
        return own or (self.item is not None and self.item.mixes_bool()) or any(x.mixes_bool() for x in self.fields.values())


def infer(rows: Iterable[dict | None]) -> Shape:
    shape = Shape()
    for row in rows:
        if row is not None and not isinstance(row, dict):
            raise TypeError(f"a row is a dict or null, not {type(row).__name__}")
        shape.see(row)
    return shape


def strict(rows: Iterable[dict | None]) -> None:
    """Raise unless all rows have the same keys."""
    keys = None
    for row in rows:
        if row is None:
            continue
        if keys is None:
            keys = set(row)
        elif set(row) != keys:
            raise ValueError(f"keys differ: {sorted(keys ^ set(row))}")


def coerce(value: Any, kind: T.DataType) -> Any:
    """A value as a column of this type holds it. Numbers widen (bool to int, bool or int to float); nothing narrows."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise TypeError(f"{value!r} isn't a struct")
        return {f.name: coerce(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{value!r} isn't a list")
        return [coerce(x, kind.elementType) for x in value]
    if isinstance(kind, T.StringType):
        if not isinstance(value, str):
            raise TypeError(f"{value!r} isn't a string")
        return value
    if isinstance(kind, T.BooleanType):
        if not isinstance(value, bool):
            raise TypeError(f"{value!r} isn't a bool")
        return value
    if isinstance(kind, (T.LongType, T.IntegerType)):
        if not isinstance(value, int):
            raise TypeError(f"{value!r} isn't an integer")
        edge = _LONG if isinstance(kind, T.LongType) else 1 << 31
        if not -edge <= value < edge:
            raise OverflowError(f"{value} doesn't fit {kind.simpleString()}")
        return int(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if not isinstance(value, (bool, int, float)):
            raise TypeError(f"{value!r} isn't a number")
        return float(value)
    return value


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types in order, nested types included; nullability doesn't count."""
    return [(f.name, f.dataType.simpleString()) for f in a] == [(f.name, f.dataType.simpleString()) for f in b]
