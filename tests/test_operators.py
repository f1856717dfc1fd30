"""Operators on literal rows."""

import pytest

from tarn.errors import AnalysisError
from tarn.functions.aggregates import Agg
from tarn.functions.predicates import Op
from tarn.operators import aggregate, bloom_join, filter_rows, gather, hash_join, hash_partition, join, order_by, project, ranges, rename, rows, scan, select_all, shuffle, subquery_join, two_phase, values
from tarn.types import Type, schema

INTS = schema([Type.INT, Type.INT], ["g", "v"])


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def numbers(spark):
    return rows(spark, [(1, 2), (1, 4), (1, 6), (3, 2), (3, 4), (3, 6), (5, 7)], INTS)


@pytest.mark.parametrize(
    ("fn", "want"),
    [(Agg.SUM, [(1, 12), (3, 12), (5, 7)]), (Agg.AVG, [(1, 4), (3, 4), (5, 7)]), (Agg.MIN, [(1, 2), (3, 2), (5, 7)]), (Agg.MAX, [(1, 6), (3, 6), (5, 7)]), (Agg.COUNT, [(1, 3), (3, 3), (5, 1)])],
)
def test_aggregates_by_group(numbers, fn, want):
    assert got(aggregate(numbers, "v", fn, "g")) == want
    assert got(two_phase(numbers, "v", fn, "g")) == want


def test_group_by_text(spark):
    df = rows(spark, [("a", 2), ("a", 4), ("a", 6), ("b", 2), ("b", 4), ("b", 6), ("c", 7)], schema([Type.STRING, Type.INT], ["g", "v"]))
    assert got(aggregate(df, "v", Agg.SUM, "g")) == [("a", 12), ("b", 12), ("c", 7)]
    assert got(aggregate(df, "g", Agg.COUNT)) == [(7,)]
    with pytest.raises(AnalysisError):
        aggregate(df, "g", Agg.MAX)


@pytest.mark.parametrize("fn", [Agg.COUNT, Agg.SUM, Agg.AVG, Agg.MIN])
def test_no_rows_give_no_row(numbers, fn):
    empty = numbers.where("g > 100")
    assert got(aggregate(empty, "v", fn)) == []
    assert got(two_phase(empty, "v", fn)) == []


def test_average_is_cut_off_towards_zero(spark):
    df = rows(spark, [(-3, 0), (-4, 0)], INTS)
    assert got(aggregate(df, "g", Agg.AVG)) == [(-3,)]
    assert got(two_phase(df, "g", Agg.AVG)) == [(-3,)]


def test_sums_wrap_on_request_only(spark):
    df = rows(spark, [(2_000_000_000, 0), (2_000_000_000, 1)], INTS)
    assert got(aggregate(df, "g", Agg.SUM)) == [(4_000_000_000,)]
    assert got(aggregate(df, "g", Agg.SUM, int32=True)) == [(4_000_000_000 - 2**32,)]
    assert got(aggregate(df, "g", Agg.AVG, int32=True)) == [(-147_483_648,)]


def test_sum_count_states(numbers):
    assert [tuple(r[1]) for r in sorted(aggregate(numbers, "v", Agg.SUM_COUNT, "g").collect())] == [(12, 3), (12, 3), (7, 1)]


@pytest.mark.parametrize("op", list(Op))
@pytest.mark.parametrize("value", [-1, 0, 1])
def test_comparisons(spark, op, value):
    near = [value - 1, value, value + 1]
    df = rows(spark, [(v,) for v in near], schema([Type.INT], ["v"]))
    want = {Op.EQUALS: [value], Op.LIKE: [value], Op.NOT_EQUALS: [value - 1, value + 1], Op.GREATER_THAN: [value + 1], Op.GREATER_THAN_OR_EQ: [value, value + 1], Op.LESS_THAN: [value - 1], Op.LESS_THAN_OR_EQ: [value - 1, value]}[op]
    assert got(filter_rows(df, "v", op, value)) == [(v,) for v in want]


def test_like_is_containment(spark):
    df = rows(spark, [("a%bc",), ("axbc",)], schema([Type.STRING], ["s"]))
    assert got(filter_rows(df, "s", Op.LIKE, "%b")) == [("a%bc",)]
    assert got(filter_rows(df, 0, Op.LIKE, "bc")) == [("a%bc",), ("axbc",)]


def test_filters_of_a_range(spark):
    df = rows(spark, [(i,) for i in range(-5, 5)], schema([Type.INT], ["v"]))
    assert len(got(filter_rows(df, "v", Op.LESS_THAN, 2))) == 7
    assert got(filter_rows(df, "v", Op.LESS_THAN, -5)) == []
    for v in (-5, 0, 4):
        assert got(filter_rows(df, "v", Op.EQUALS, v)) == [(v,)]


def test_text_beside_a_number_is_an_error(numbers):
    with pytest.raises(AnalysisError):
        filter_rows(numbers, "v", Op.EQUALS, "many")


@pytest.fixture
def sides(spark):
    a = rows(spark, [(1, 2), (3, 4), (5, 6), (7, 8)], schema([Type.INT] * 2, ["a", "b"]))
    return a, rows(spark, [(1, 2, 3), (2, 3, 4), (3, 4, 5), (4, 5, 6), (5, 6, 7)], schema([Type.INT] * 3, ["c", "d", "e"]))


def test_joins(sides):
    a, b = sides
    equal = [(1, 2, 1, 2, 3), (3, 4, 3, 4, 5), (5, 6, 5, 6, 7)]
    assert got(join(a, b, [("a", Op.EQUALS, "c")])) == equal
    assert got(hash_join(a, b, "a", "c")) == equal
    for strategy in ("hash", "merge", "nested"):
        assert got(join(a, b, [("a", Op.EQUALS, "c")], strategy)) == equal
    assert len(got(join(a, b, [("a", Op.GREATER_THAN, "c")]))) == 11
    assert got(join(a, b, [("a", Op.EQUALS, "c"), ("b", Op.LESS_THAN, "e"), ("b", Op.NOT_EQUALS, "d")])) == []
    with pytest.raises(AnalysisError):
        join(a, b, [])


def test_subquery_join_keeps_multiplicity(spark, sides):
    inner = rows(spark, [(1,), (1,), (9,)], schema([Type.INT], ["k"]))
    assert got(subquery_join(sides[0], "a", Op.EQUALS, inner)) == [(1, 2, 1), (1, 2, 1)]


def test_text_joins_with_text_only(spark, sides):
    words = rows(spark, [("x",)], schema([Type.STRING], ["w"]))
    with pytest.raises(AnalysisError):
        join(sides[0], words, [("a", Op.EQUALS, "w")])


def test_bloom_join_changes_no_result(spark):
    large = spark.range(20_000).selectExpr("cast(id as int) as k", "id % 7 as v")
    small = spark.range(300).selectExpr("id * 50 as s")
    want = got(join(large, small, [("k", Op.EQUALS, "s")]))
    assert got(bloom_join(large, "k", small, "s", force=True)) == want and len(want) == 300
    from tarn.operators.exchange import bloom_filtered

    assert 300 <= bloom_filtered(large, "k", small, "s").count() < 1500
    assert bloom_filtered(large, "k", small, "s", most_bits=64) is large
    assert got(bloom_join(large, "k", small.where("s < 0"), "s", force=True)) == []


def test_projection_and_renaming(numbers):
    assert project(numbers, [1, 0, 1], ["x", "y", "z"]).columns == ["x", "y", "z"]
    assert got(project(numbers, [1]))[0] == (2,)
    assert rename(numbers, 0, "key").columns == ["key", "v"]
    assert got(rename(numbers, 1, "w")) == got(numbers)
    assert select_all(numbers.toDF("a", "a")).columns == ["a", "a_2"]
    with pytest.raises(AnalysisError):
        rename(numbers, 2, "x")
    with pytest.raises(AnalysisError):
        project(numbers, [2])


def test_scan_prefixes_names(numbers):
    assert scan(numbers, "t").columns == ["t.g", "t.v"]
    assert got(scan(numbers, "t").where("`t.g` = 5")) == [(5, 7)]


def test_order(numbers):
    assert [r.v for r in order_by(numbers, "v", False, "g").collect()] == [7, 6, 6, 4, 4, 2, 2]


def test_rows_are_checked(spark):
    with pytest.raises(AnalysisError):
        rows(spark, [(1, "x")], INTS)
    with pytest.raises(AnalysisError):
        rows(spark, [(1,)], INTS)
    assert got(values(spark, (4, 5), INTS)) == [(4, 5)]


def test_exchange(spark):
    df = rows(spark, [(i, i) for i in range(-8, 9)], INTS)
    assert all(r.part_id == r.g % 3 for r in hash_partition(df, "g", 3).collect())
    assert shuffle(df, "g", 3).rdd.getNumPartitions() == 3 and got(shuffle(df, "g", 3)) == got(df)
    assert gather(df).rdd.getNumPartitions() == 1
    assert ranges(10, 3) == [(0, 3), (3, 6), (6, 10)] and ranges(1, 2) == [(0, 0), (0, 1)]
