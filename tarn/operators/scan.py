"""Row sources."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..functions.predicates import quoted


def scan(table: DataFrame, alias: str | None = None) -> DataFrame:
    """A full scan; with an alias, every column is called alias.column, as long as it stays a scan of many columns
    only those used reach the file reader."""
    return table.select(*(quoted(c).alias(f"{alias}.{c}") for c in table.columns)) if alias else table


#: What may stand for a value of a type in rows().
PYTHON = {T.IntegerType: int, T.LongType: int, T.ShortType: int, T.StringType: str, T.DoubleType: (int, float), T.BooleanType: bool}


def rows(spark: SparkSession, data: Iterable[Sequence], schema: T.StructType) -> DataFrame:
    """Rows held in memory. Each is checked against the schema, in number of fields and types."""
    kept = [tuple(r) for r in data]
    for r in kept:
        if len(r) != len(schema.fields):
            raise AnalysisError(f"{len(r)} values for {len(schema.fields)} fields: {r!r}")
        for v, f in zip(r, schema.fields, strict=True):
            want = PYTHON.get(type(f.dataType))
            if v is not None and want and (not isinstance(v, want) or (isinstance(v, bool) and want is not bool)):
                raise AnalysisError(f"{v!r} is no {f.dataType.simpleString()} (field {f.name})")
    return spark.createDataFrame(kept, schema)


def values(spark: SparkSession, row: Sequence, schema: T.StructType) -> DataFrame:
    """One row of literals, as INSERT ... VALUES has it."""
    return rows(spark, [row], schema)
