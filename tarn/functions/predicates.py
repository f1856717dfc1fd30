"""The seven comparisons, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError, ParseError


class Op(Enum):
    """Numbered as clients of the engine know them. LIKE is containment of text, without wildcards; on numbers, equality."""

    EQUALS = 0
    GREATER_THAN = 1
    LESS_THAN = 2
    LESS_THAN_OR_EQ = 3
    GREATER_THAN_OR_EQ = 4
    LIKE = 5
    NOT_EQUALS = 6

    def __str__(self) -> str:
        return SYMBOLS[self]

    @classmethod
    def token(cls, text: str) -> Op:
        found = TOKENS.get(text.upper())
        if found is None:
            raise ParseError(f"unknown predicate {text!r}")
        return found

    def mirrored(self) -> Op:
        """The operator with its sides exchanged: 5 < x is x > 5."""
        if self is Op.LIKE:
            raise ParseError("the text to look for stands right of LIKE")
        return MIRROR.get(self, self)


SYMBOLS = {Op.EQUALS: "=", Op.GREATER_THAN: ">", Op.LESS_THAN: "<", Op.LESS_THAN_OR_EQ: "<=", Op.GREATER_THAN_OR_EQ: ">=", Op.LIKE: "like", Op.NOT_EQUALS: "<>"}
TOKENS = {s.upper(): o for o, s in SYMBOLS.items()} | {"!=": Op.NOT_EQUALS, "~": Op.LIKE}
MIRROR = {Op.GREATER_THAN: Op.LESS_THAN, Op.LESS_THAN: Op.GREATER_THAN, Op.GREATER_THAN_OR_EQ: Op.LESS_THAN_OR_EQ, Op.LESS_THAN_OR_EQ: Op.GREATER_THAN_OR_EQ}


def quoted(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def literal(value: Any, kind: T.DataType) -> Column:
    """A constant for a column of that type; text that is no number can't stand beside a number column."""
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if isinstance(kind, T.NumericType):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return F.lit(value)
        try:
            return F.lit(int(value)) if isinstance(kind, T.IntegralType) else F.lit(float(value))
        except (TypeError, ValueError):
            raise AnalysisError(f"{value!r} is no {kind.simpleString()}") from None
    return F.lit(value).cast(kind)


def compare(op: Op, left: Column, right: Column, text: bool) -> Column:
    """left op right; text: whether they are strings (LIKE on anything else is equality)."""
    if op is Op.LIKE:
        return F.contains(left, right) if text else left == right
    return {
        Op.EQUALS: left == right,
        Op.NOT_EQUALS: left != right,
        Op.GREATER_THAN: left > right,
        Op.GREATER_THAN_OR_EQ: left >= right,
        Op.LESS_THAN: left < right,
        Op.LESS_THAN_OR_EQ: left <= right,
    }[op]


def predicate(df: DataFrame, field: str | int, op: Op, value: Any) -> Column:
    """A field of df, by name or position, against a constant."""
    f = df.schema.fields[field] if isinstance(field, int) else df.schema[field]
    return compare(op, quoted(f.name), literal(value, f.dataType), isinstance(f.dataType, T.StringType))


def join_predicate(left: DataFrame, field1: str, op: Op, right: DataFrame, field2: str) -> Column:
    """A field of left against a field of right; strings compare with strings only."""
    a, b = left.schema[field1].dataType, right.schema[field2].dataType
    if isinstance(a, T.StringType) != isinstance(b, T.StringType):
        raise AnalysisError(f"can't compare {field1} ({a.simpleString()}) with {field2} ({b.simpleString()})")
    return compare(op, left["`" + field1 + "`"], right["`" + field2 + "`"], isinstance(a, T.StringType))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
