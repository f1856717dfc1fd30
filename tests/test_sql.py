"""The SQL front end: accepted statements, refusals, and the students-and-advisors queries."""

import random

import pytest

from tarn.engine import Engine, render
from tarn.errors import AnalysisError, EngineError, ParseError
from tarn.operators import rows
from tarn.plans.draw import tree
from tarn.plans.parser import parse, statements
from tarn.types import Type, schema


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    names = [f"advisor{i // 2}" for i in range(18)]
    e.catalog.add("advisor", rows(spark, list(enumerate(names)), schema([Type.INT, Type.STRING], ["id", "name"])), "id")
    rng = random.Random(3)
    students = [(i, f"student{i % 7}", rng.randrange(18)) for i in range(700)]
    e.catalog.add("student", rows(spark, students, schema([Type.INT, Type.STRING, Type.INT], ["id", "name", "aid"])), "id")
    return e


def got(df):
    return list(map(tuple, df.collect()))


@pytest.mark.parametrize(("fn", "want"), [("count", 700), ("max", 699), ("min", 0), ("avg", 349)])
def test_whole_aggregates(engine, fn, want):
    df = engine.sql(f"select {fn}(id) from student;")
    assert df.columns == [f"{fn}(student.id)"] and got(df) == [(want,)]


def test_groups_joins_and_order(engine):
    assert sorted(got(engine.sql("SELECT name, COUNT(id) FROM student GROUP BY name"))) == [(f"student{i}", 100) for i in range(7)]
    joined = engine.sql("select * from student s, advisor a where s.aid = a.id")
    assert joined.columns == ["s.id", "s.name", "s.aid", "a.id", "a.name"] and joined.count() == 700
    assert [r[0] for r in got(engine.sql("select id from advisor order by id desc"))] == list(range(17, -1, -1))
    assert [r[0] for r in got(engine.sql("select name from advisor order by id desc"))][0] == "advisor8"


def test_constant_on_the_left_is_mirrored(engine):
    assert sorted(got(engine.sql("select id from advisor where 15 < id"))) == [(16,), (17,)]


def test_cyclic_and_repeated_comparisons(engine):
    sql = "select a.id from advisor a, advisor b, advisor c where a.id = b.id and b.id = c.id and c.id = a.id and a.id < 3 and a.name = b.name"
    assert sorted(got(engine.sql(sql))) == [(0,), (1,), (2,)]


def test_subquery_join_keeps_copies(engine):
    sql = "select a.id from advisor a where a.name = (select name from advisor where id < 4)"
    assert len(got(engine.sql(sql))) == 8


@pytest.mark.parametrize(
    "sql",
    [
        "select distinct id from advisor",
        "select id from advisor where id = 1 or id = 2",
        "select id from advisor where not id = 1",
        "select id from advisor where id in (1, 2)",
        "select id from advisor where id between 1 and 2",
        "select id from advisor where id is null",
        "select id from advisor where exists (select id from advisor)",
        "select id + 1 from advisor",
        "select id from advisor where id + 1 = 2",
        "select upper(name) from advisor",
        "select min(id), max(id) from advisor",
        "select count(*) from advisor",
        "select count(distinct id) from advisor",
        "select id from advisor group by id",
        "select name, count(id) from advisor group by name, id",
        "select name, count(id) from advisor group by name having count(id) > 1",
        "select id from advisor order by id, name",
        "select id from advisor limit 3",
        "select id from advisor union select id from student",
        "select a.id from advisor a join student s on a.id = s.aid",
        "select a.id from advisor a, student s",
        "select a.id from advisor a where a.id = a.id",
        "select *, id from advisor",
        "select id from (select id from advisor) x",
        "select a.b.c from advisor a",
        "update advisor set id = 1",
        "create table x (id int)",
        "drop table advisor",
        "select id from advisor where 'x' like name",
        "select id frm advisor",
        "select 1 from advisor",
        "select id from advisor where 1 = 1",
        "",
    ],
)
def test_refusals(engine, sql):
    with pytest.raises(ParseError):
        engine.sql(sql)


@pytest.mark.parametrize(
    "sql",
    [
        "select nothing from advisor",
        "select id from nowhere",
        "select id from advisor a, student s where a.id = s.aid",
        "select x.id from advisor a",
        "select id from advisor where id = 'one'",
        "select max(name) from advisor",
        "select id, count(name) from advisor group by name",
        "select name, count(id) from advisor group by name order by id",
        "select a.id from advisor a, student a where a.id = a.id",
        "select a.id from advisor a, student s where a.id = s.name",
    ],
)
def test_analysis_errors(engine, sql):
    with pytest.raises((AnalysisError, ParseError)) as e:
        engine.sql(sql)
    assert isinstance(e.value, EngineError)


def test_results_as_text(engine):
    text = render(engine.sql("select id, name from advisor where id < 2 order by id"))
    assert text.splitlines()[0] == "advisor.id\tadvisor.name" and text.endswith(" 2 rows.")


def test_statements_and_drawing():
    assert statements("select 'a;b' from t; -- done; \n commit;") == ["select 'a;b' from t", "-- done; \n commit"]
    drawn = tree(parse("select a.id, count(s.id) from advisor a, student s where a.id = s.aid and a.id < 3 group by a.id order by a.id"))
    for sign in "π⨝σρgo":
        assert sign in drawn
    assert "explain" not in drawn


def test_explain(engine):
    text = engine.explain("select s.id from student s, advisor a where s.aid = a.id")
    assert "⨝" in text and "Physical Plan" in text


def test_quotes(engine):
    assert got(engine.sql("select id from advisor where name = 'it''s'")) == []
