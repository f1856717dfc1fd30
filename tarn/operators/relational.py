"""Projection, renaming, filters, sorting."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame

from ..errors import AnalysisError
from ..functions.predicates import Op, predicate, quoted


def project(df: DataFrame, fields: Sequence[int | str], names: Sequence[str] | None = None) -> DataFrame:
    """Columns by position or name, in any order, repeated or not; names, if given, are their new ones."""
    if any(isinstance(f, int) and not 0 <= f < len(df.columns) for f in fields):
        raise AnalysisError(f"field positions {fields} outside 0..{len(df.columns) - 1}")
    old = [df.columns[f] if isinstance(f, int) else f for f in fields]
    if len(set(df.columns)) < len(df.columns):  # names repeat: give each column its own first
        own = [f"_{i}" for i in range(len(df.columns))]
        at = [f if isinstance(f, int) else df.columns.index(f) for f in fields]
        return df.toDF(*own).select(*(quoted(own[i]).alias(n) for i, n in zip(at, names or old, strict=True)))
    return df.select(*(quoted(o).alias(n) for o, n in zip(old, names or old, strict=True)))


def select_all(df: DataFrame) -> DataFrame:
    """Every column; of names that occur twice, the later ones get a number."""
    seen: dict[str, int] = {}
    out = []
    for c in df.columns:
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df if out == df.columns else df.toDF(*out)


def rename(df: DataFrame, position: int, name: str) -> DataFrame:
    """One column, by position, under a new name; values stay."""
    if not 0 <= position < len(df.columns):
        raise AnalysisError(f"no column at position {position}")
    return df.toDF(*(name if i == position else c for i, c in enumerate(df.columns)))


def filter_rows(df: DataFrame, field: str | int, op: Op, value: Any) -> DataFrame:
    return df.where(predicate(df, field, op, value))


def order_by(df: DataFrame, field: str, ascending: bool = True, *ties: str) -> DataFrame:
    """A global sort, range-partitioned. Spark's is not stable: name further columns where the order of ties counts."""
    key: Column = quoted(field).asc() if ascending else quoted(field).desc()
    return df.orderBy(key, *(quoted(t) for t in ties))
