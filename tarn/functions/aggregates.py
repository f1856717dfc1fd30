"""Aggregate functions: whole, or as the partial and final halves of a two-phase aggregation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError, ParseError
from .predicates import quoted


class Agg(Enum):
    """Numbered as clients know them. SUM_COUNT is AVG's partial state, SC_AVG its final step."""

    MIN = 0
    MAX = 1
    SUM = 2
    AVG = 3
    COUNT = 4
    SUM_COUNT = 5
    SC_AVG = 6

    @classmethod
    def named(cls, name: str) -> Agg | Custom:
        found = CUSTOM.get(name.upper()) or cls.__members__.get(name.upper())
        if not found:
            raise ParseError(f"unknown aggregate {name!r}")
        return found


@dataclass(frozen=True)
class Custom:
    """An aggregate of the caller's: partial makes a state of a column's values (an aggregate expression), combine a result
    of states; whole does both, if there is a shorter way. strings: whether it takes columns of text."""

    name: str
    partial: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    whole: Callable[[Column], Column] | None = None
    strings: bool = False


CUSTOM: dict[str, Custom] = {}


def register(fn: Custom) -> Custom:
    """Makes fn known to SQL by its name, which must not be a built-in one's."""
    if fn.name.upper() in Agg.__members__:
        raise AnalysisError(f"{fn.name} is built in")
    CUSTOM[fn.name.upper()] = fn
    return fn


def wrapped(total: Column) -> Column:
    """A sum as a 32-bit accumulator would have it: its low 32 bits, with their sign."""
    return F.shiftright(F.shiftleft(total, 32), 32).cast("int")


def aggregate(fn: Agg | Custom, name: str, kind: T.DataType, int32: bool = False) -> Column:
    """fn over a column. AVG of whole numbers is a whole number; text can only be counted.

    int32: sums, and averages' sums, wrap around at 32 bits.
    """
    c = quoted(name)
    if isinstance(kind, T.StringType) and fn is not Agg.COUNT and not (isinstance(fn, Custom) and fn.strings):
        raise AnalysisError(f"{fn.name} of the string column {name}: strings can only be counted")
    if isinstance(fn, Custom):
        if not fn.whole:
            raise AnalysisError(f"{fn.name} works in two phases only")
        return fn.whole(c)
    whole = isinstance(kind, T.IntegralType)
    if fn is Agg.MIN:
        return F.min(c)
    if fn is Agg.MAX:
        return F.max(c)
    if fn is Agg.COUNT:
        return F.count(c)
    if fn is Agg.SUM:
        return wrapped(F.sum(c)) if int32 and whole else F.sum(c)
    if fn is Agg.AVG:
        if not whole:
            return F.avg(c)
        total = f"sum({_sql(name)})"
        return F.expr(f"{f'shiftright(shiftleft({total}, 32), 32)' if int32 else total} div count({_sql(name)})")
    if fn is Agg.SUM_COUNT:
        return F.struct(F.sum(c).alias("sum"), F.count(c).alias("count"))
    raise AnalysisError("SC_AVG needs SUM_COUNT states: see final()")


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: fn -> (function below the exchange, function above it).
PHASES = {Agg.MIN: (Agg.MIN, Agg.MIN), Agg.MAX: (Agg.MAX, Agg.MAX), Agg.SUM: (Agg.SUM, Agg.SUM), Agg.COUNT: (Agg.COUNT, Agg.SUM), Agg.AVG: (Agg.SUM_COUNT, Agg.SC_AVG)}


def final(fn: Agg, state: str, whole: bool = True) -> Column:
    """The upper half: combines the states in a column; SC_AVG takes structs of sum and count."""
    if fn is not Agg.SC_AVG:
        return {Agg.MIN: F.min, Agg.MAX: F.max, Agg.SUM: F.sum}[fn](quoted(state))
    s, c = f"sum({_sql(state)}.sum)", f"sum({_sql(state)}.count)"
    return F.expr(f"{s} div {c}" if whole else f"{s} / {c}")
