"""Inner joins on one comparison or several; both sides' columns are kept, keys included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..errors import AnalysisError
from ..functions.predicates import Op, all_of, join_predicate

#: Physical strategies that a caller may ask for; without one, sizes and adaptive execution decide.
STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "nested": "shuffle_replicate_nl"}


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of a side of which each shuffle partition's hash table may hold so many.
HASH_BYTES = 64 << 20


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, Op, str] | tuple[str, Op, str, bool]], strategy: str | None = None) -> DataFrame:
    """left's columns, then right's, for pairs of rows that meet all conditions (field of left, op, field of right; and True
    if the field of right stands left of op).

    Equal keys make a hash or sort-merge join that Spark deals out by key (and whose skewed keys it
    splits); other comparisons alone make a nested loop, whose smaller side Spark sends around.
    """
    if not on:
        raise AnalysisError("a join needs a condition; cross products are not supported")
    if strategy:
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, all_of(join_predicate(right, b, op, left, a) if turned else join_predicate(left, a, op, right, b) for a, op, b, *turned in on), "inner")


def hash_join(left: DataFrame, right: DataFrame, field1: str, field2: str) -> DataFrame:
    """An equi-join by shuffled hash tables, which can't spill: only where the optimizer's estimate of right says that one
    fits into each partition; else sizes and adaptive execution decide."""
    fits = size_in_bytes(right) <= HASH_BYTES * int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return join(left, right, [(field1, Op.EQUALS, field2)], "hash" if fits else None)


def subquery_join(outer: DataFrame, field: str, op: Op, inner: DataFrame) -> DataFrame:
    """outer joined with a subquery's result on the first of its columns; the result keeps both and all multiplicities."""
    return join(outer, inner, [(field, op, inner.columns[0])])
