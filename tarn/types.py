"""The two declared types, schemas and rows as this engine's catalog and paged files have them."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import types as T

from .errors import AnalysisError

#: Fixed values of the paged format: bytes of text in a string field, bytes of a page.
STRING_BYTES, PAGE_BYTES = 128, 4096


class Type(Enum):
    """A declared type: its name in catalogs, its Spark type, its width in a page."""

    INT = ("int", T.IntegerType(), 4)
    STRING = ("string", T.StringType(), 4 + STRING_BYTES)

    @property
    def label(self) -> str:
        return self.value[0]

    @property
    def spark(self) -> T.DataType:
        return self.value[1]

    @property
    def width(self) -> int:
        return self.value[2]

    @classmethod
    def named(cls, name: str) -> Type:
        for t in cls:
            if t.label == name.strip().lower():
                return t
        raise AnalysisError(f"unknown type {name!r}: int or string")

    @classmethod
    def of(cls, t: T.DataType) -> Type:
        for x in cls:
            if x.spark == t:
                return x
        raise AnalysisError(f"no declared type for {t.simpleString()}")


def schema(types: Sequence[Type], names: Sequence[str] | None = None) -> T.StructType:
    """A schema of declared types; without names, fields are unnamed (empty names)."""
    names = names if names is not None else [""] * len(types)
    if len(types) != len(names) or not types:
        raise AnalysisError("a schema has at least one field, and a name for each")
    return T.StructType([T.StructField(n, t.spark) for n, t in zip(names, types, strict=True)])


def merge(a: T.StructType, b: T.StructType) -> T.StructType:
    """The schema of a joined row: all of a's fields, then all of b's."""
    return T.StructType([*a.fields, *b.fields])


def field_index(s: T.StructType, name: str) -> int:
    """The first field of that name."""
    for i, f in enumerate(s.fields):
        if f.name == name:
            return i
    raise AnalysisError(f"no field {name!r} in ({', '.join(s.names)})")


def same_types(a: T.StructType, b: T.StructType) -> bool:
    """Schemas are equal when their types are, whatever the names."""
    return [f.dataType for f in a.fields] == [f.dataType for f in b.fields]


def row_bytes(s: T.StructType) -> int:
    return sum(Type.of(f.dataType).width for f in s.fields)


def format_row(row: Sequence) -> str:
    return "\t".join("null" if v is None else str(v) for v in row)
