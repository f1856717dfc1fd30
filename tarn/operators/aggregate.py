"""One aggregate over all rows or by one column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import PHASES, Agg, Custom, final
from ..functions.aggregates import aggregate as expression
from ..functions.predicates import quoted


def _grouped(df: DataFrame, group: str | None):  # noqa: ANN202
    """Grouping by a constant makes an aggregate over no rows give no row."""
    return df.groupBy(quoted(group) if group else F.lit(0).alias("__all"))


def aggregate(df: DataFrame, field: str, fn: Agg | Custom, group: str | None = None, name: str | None = None, int32: bool = False) -> DataFrame:
    """(group, value), or (value) over all rows; no rows in, none out. Spark sums up before and after the exchange."""
    name = name or f"{fn.name.lower()}({field})"
    if isinstance(fn, Custom) and not fn.whole:
        return two_phase(df, field, fn, group, name)
    out = _grouped(df, group).agg(expression(fn, field, df.schema[field].dataType, int32).alias(name))
    return out if group else out.drop("__all")


def two_phase(df: DataFrame, field: str, fn: Agg | Custom, group: str | None = None, name: str | None = None, parts: int = 8) -> DataFrame:
    """The same result by explicit partial states per part of the input, then their combination.

    Spark does this by itself; this form keeps the states' form (SUM_COUNT for AVG) visible, and deals a group's
    states to parts by the partition that its rows come from, so a key with many large states meets in steps.
    """
    name = name or f"{fn.name.lower()}({field})"
    lower, upper = (fn, fn) if isinstance(fn, Custom) else PHASES[fn]
    kind = df.schema[field].dataType
    salt = F.pmod(F.spark_partition_id(), F.lit(parts)).alias("__part")
    keys = [quoted(group)] if group else []
    state = fn.partial(quoted(field)) if isinstance(fn, Custom) else expression(lower, field, kind)
    partial = df.groupBy(*keys, salt).agg(state.alias("__state"))
    combined = fn.combine(quoted("__state")) if isinstance(fn, Custom) else final(upper, "__state", isinstance(kind, T.IntegralType))
    out = _grouped(partial, group).agg(combined.alias(name))
    return out if group else out.drop("__all")
