"""Delimited text: as a DataFrame, or converted to a paged file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..types import Type, schema
from .heapfile import write_pages


def load_text(spark: SparkSession, path: str, s: T.StructType, sep: str = ",") -> DataFrame:
    """A declared, never inferred, schema; blank lines are skipped, values trimmed, and a value that doesn't fit is an error."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("v")).where(F.trim("v") != "")
    parts = F.split("v", "\\Q" + sep + "\\E", -1)
    checked = raw.select(F.when(F.size(parts) == len(s.fields), parts).otherwise(F.raise_error(F.concat(F.lit("fields in line: "), F.col("v")))).alias("p"))
    return checked.select(*(F.trim(F.get("p", F.lit(i))).cast(f.dataType).alias(f.name) for i, f in enumerate(s.fields)))


def parse_lines(lines: Iterator[str], types: Sequence[Type], sep: str = ",") -> Iterator[tuple]:
    """Lines -> rows: carriage returns go, blank lines are skipped, values trimmed; the last line needs no newline."""
    for number, line in enumerate(lines, 1):
        line = line.replace("\r", "").rstrip("\n")
        if not line.strip():
            continue
        values = [v.strip() for v in line.split(sep)]
        if len(values) != len(types):
            raise EngineError(f"line {number}: {len(values)} values for {len(types)} fields")
        try:
            yield tuple(int(v) if t is Type.INT else v for v, t in zip(values, types, strict=True))
        except ValueError:
            raise EngineError(f"line {number}: {line!r} has a value that is no int") from None


def convert(source: str, n_fields: int, types: Sequence[Type] | None = None, sep: str = ",", target: str | None = None) -> tuple[str, int]:
    """A text file to a .dat file beside it, line by line; all ints unless types say otherwise. Path and rows."""
    kinds = list(types) if types else [Type.INT] * n_fields
    if len(kinds) != n_fields:
        raise EngineError(f"{len(kinds)} types for {n_fields} fields")
    target = target or source.rsplit(".", 1)[0] + ".dat"
    with open(source) as f:
        return target, write_pages(target, parse_lines(f, kinds, sep), schema(kinds, [f"f{i}" for i in range(n_fields)]))
