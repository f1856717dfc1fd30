"""What moves rows: partition functions, shuffles, gathering, and a join behind a bloom filter."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Op, quoted
from .join import join, size_in_bytes


#: A partition function: a field's column and the number of parts -> the number of a row's part.
PartitionFunction = Callable[[Column, int], Column]


def partition_of(df: DataFrame, field: str, n: int, by: PartitionFunction | None = None) -> Column:
    """The part that a row belongs to: a whole number modulo n, never negative; of text, its hash modulo n; or what by says."""
    c = quoted(field)
    if by:
        return by(c, n)
    return F.pmod(c, F.lit(n)) if isinstance(df.schema[field].dataType, T.IntegralType) else F.pmod(F.xxhash64(c), F.lit(n))


def hash_partition(df: DataFrame, field: str, n: int, name: str = "part_id", by: PartitionFunction | None = None) -> DataFrame:
    """df with the number of each row's part."""
    return df.withColumn(name, partition_of(df, field, n, by))


def range_function(cuts: list) -> PartitionFunction:
    """Parts by range: a value's part is the number of cuts that are at most it; nulls are in part 0."""
    return lambda c, n: F.least(F.lit(n - 1), sum((F.when(c >= F.lit(x), 1).otherwise(0) for x in sorted(cuts)), F.lit(0)))


def shuffle(df: DataFrame, field: str, n: int, by: PartitionFunction | None = None) -> DataFrame:
    """Rows of equal keys (by: of equal parts) in one partition, of n."""
    return df.repartition(n, by(quoted(field), n) if by else quoted(field))


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition, for results of known size only. What comes before stays as parallel as it is."""
    return df.repartition(1)


def ranges(n: int, parts: int) -> list[tuple[int, int]]:
    """n rows in contiguous ranges [from, to) whose sizes differ by one at most."""
    return [(n * i // parts, n * (i + 1) // parts) for i in range(parts)]


#: A filter pays where the large side has over so many bytes and over so many times the small side's.
LEAST_BYTES, TIMES = 1 << 20, 5
#: Bits for each key, hash functions, and the most bits: 1 MB, which is what a filter can send to the driver and back.
BITS_EACH, HASHES, MOST_BITS = 10, 5, 1 << 23
#: Bytes of a key and its row, as the optimizer estimates them at least.
KEY_BYTES = 16


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom_filtered(large: DataFrame, field: str, small: DataFrame, small_field: str, most_bits: int = MOST_BITS) -> DataFrame:
    """large without most of the rows whose key small lacks (and with all whose key it has), before any exchange.

    The filter is an array of 64-bit words, or-ed together from the small side's parts when the plan runs (a scalar
    subquery; nothing runs while the plan is made). Its size follows the optimizer's estimate of the small side, at most
    most_bits; where that would be too full to help, large comes back as it is. Nulls never match and go.
    """
    keys = small.select(quoted(small_field).cast(large.schema[field].dataType).alias("k")).where("k is not null")
    bits = 1 << max(10, math.ceil(math.log2(max(1, size_in_bytes(keys) // KEY_BYTES) * BITS_EACH)))
    if bits > most_bits:
        return large
    places = keys.select(F.explode(F.array(*_places(F.col("k"), bits))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    full = small.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    table = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("t")).scalar()
    hit = F.lit(True)
    for p in _places(quoted(field), bits):
        hit = hit & (F.call_function("shiftright", F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return large.where(quoted(field).isNotNull() & hit)


def bloom_join(large: DataFrame, field: str, small: DataFrame, small_field: str, force: bool = False) -> DataFrame:
    """large joined with small on equal keys; behind a bloom filter where the sizes say that it pays (or force)."""
    a, b = size_in_bytes(large), size_in_bytes(small)
    if force or (a > LEAST_BYTES and a > TIMES * b):
        large = bloom_filtered(large, field, small, small_field)
    return join(large, small, [(field, Op.EQUALS, small_field)])
