"""Paged files, delimited text, catalogs, schemas."""

import random

import numpy as np
import pytest

from tarn.catalog import Catalog, parse_catalog
from tarn.engine import main
from tarn.errors import AnalysisError, EngineError, ParseError
from tarn.sources.heapfile import decode_pages, encode_page, header_bytes, read_heap, slots_per_page, split_heap, write_heap, write_pages
from tarn.sources.text import convert, load_text
from tarn.types import PAGE_BYTES, Type, field_index, merge, same_types, schema

TWO = schema([Type.INT] * 2, ["a", "b"])


def test_strings_and_pushed_filters(spark, tmp_path):
    """Latin-1 texts of all lengths decode at once; comparisons of whole numbers are made before."""
    rng = random.Random(1)
    s = schema([Type.INT, Type.STRING], ["n", "s"])
    data = [(i, "".join(chr(rng.choice([*range(32, 127), *range(160, 256)])) for _ in range(rng.randrange(129)))) for i in range(300)]
    path = tmp_path / "x.dat"
    write_pages(str(path), data, s)
    assert [tuple(r) for r in read_heap(spark, str(path), s).collect()] == data
    some = read_heap(spark, str(path), s).where("n >= 100 and n < 110 and s <> 'q'")
    assert [tuple(r) for r in some.collect()] == data[100:110]
    assert "Python" in some._jdf.queryExecution().executedPlan().toString()
    batch = decode_pages(path.read_bytes(), s, [(np.greater, 0, 295)])
    assert batch.column(0).to_pylist() == [296, 297, 298, 299]


def test_page_geometry():
    assert slots_per_page(TWO) == 504 and header_bytes(TWO) == 63
    assert slots_per_page(schema([Type.INT])) == 992
    page = encode_page([(i, -i) for i in range(20)], TWO)
    assert len(page) == PAGE_BYTES and page[:3] == b"\xff\xff\x0f" and not any(page[3:63])
    assert page[63:71] == b"\0\0\0\0\0\0\0\0" and page[71:79] == b"\0\0\0\x01\xff\xff\xff\xff"
    assert decode_pages(page, TWO).to_pydict() == {"a": list(range(20)), "b": [-i for i in range(20)]}
    with pytest.raises(EngineError):
        encode_page([(0, 0)] * 505, TWO)


@pytest.mark.parametrize("n", [0, 1, 2, 511, 513, 1025])
def test_round_trips(spark, tmp_path, n):
    rng = random.Random(n)
    rows = [(rng.randrange(65536), rng.randrange(-(2**31), 2**31)) for _ in range(n)]
    path = str(tmp_path / "t.dat")
    write_pages(path, rows, TWO)
    assert sorted(map(tuple, read_heap(spark, path, TWO).collect())) == sorted(rows)


def test_empty_pages_between_and_strings(spark, tmp_path):
    s = schema([Type.STRING, Type.INT], ["s", "n"])
    path = tmp_path / "t.dat"
    path.write_bytes(encode_page([("é" * 200, 1), ("", 2)], s) + encode_page([], s) + encode_page([("日x", 3)], s)[:1000])
    assert sorted((r.n, r.s) for r in read_heap(spark, str(path), s).collect()) == [(1, "é" * 128), (2, ""), (3, "?x")]


def test_writer(spark, tmp_path):
    df = spark.range(3000).selectExpr("cast(id as int) as a", "cast(id * 2 as int) as b")
    write_heap(df.repartition(3), str(tmp_path / "h"))
    assert read_heap(spark, str(tmp_path / "h"), df.schema).selectExpr("count(*)", "sum(a)", "sum(b)").first() == (3000, 3000 * 2999 // 2, 3000 * 2999)


def test_split(spark, tmp_path):
    path = str(tmp_path / "t.dat")
    write_pages(path, [(i, i) for i in range(1001)], TWO)
    parts = split_heap(path, TWO, 3, str(tmp_path / "parts"))
    found = [[r.a for r in read_heap(spark, p, TWO).collect()] for p in parts]
    assert [len(x) for x in found] == [333, 334, 334] and sum(found, []) == list(range(1001))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("t (a int, b int)\n")
    write_pages(str(tmp_path / "t.dat"), [(i, i * i) for i in range(7)], TWO)
    assert main(["split", str(tmp_path / "c.txt"), "2", str(tmp_path / "out")]) == 0
    assert [r.a for r in read_heap(spark, str(tmp_path / "out" / "t" / "1.dat"), TWO).collect()] == [3, 4, 5, 6]
    assert main(["print", str(tmp_path / "t.dat"), "2"]) == 0
    (tmp_path / "q.sql").write_text("select a from t where b > 20 order by a; select nothing from t;")
    assert main(["parser", str(tmp_path / "c.txt"), "-explain", "-f", str(tmp_path / "q.sql")]) == 0
    said = capsys.readouterr().out
    assert "6\t36" in said and "t.a" in said and " 2 rows." in said and "AnalysisError" in said and "π(a)" in said


def test_text(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("1,10\r\n\n 2 , 20\n5,50\n5,50")
    s = load_text(spark, str(path), TWO)
    assert sorted(map(tuple, s.collect())) == [(1, 10), (2, 20), (5, 50), (5, 50)]
    target, n = convert(str(path), 2)
    assert n == 4 and sorted(map(tuple, read_heap(spark, target, TWO).collect())) == [(1, 10), (2, 20), (5, 50), (5, 50)]
    assert main(["convert", str(path), "2", "int,string"]) == 0 and main([]) == 2
    path.write_text("1,x\n")
    with pytest.raises(EngineError):
        convert(str(path), 2)
    with pytest.raises(Exception):  # noqa: B017
        load_text(spark, str(path), TWO).collect()


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.txt").write_text("venues (id int pk, name string)\nt(f1 int, f2 int)\n")
    write_pages(str(tmp_path / "venues.dat"), [(1, "a"), (2, "b")], schema([Type.INT, Type.STRING], ["id", "name"]))
    write_pages(str(tmp_path / "t.dat"), [(1, 10)], TWO)
    c = Catalog(spark)
    c.load(str(tmp_path / "c.txt"))
    assert c.frame("venues").count() == 2 and c.primary_key("venues") == "id" and c.schema("t").names == ["f1", "f2"]
    assert c.name(c.table_id("t")) == "t" and {e.name for e in c} == {"venues", "t"}
    c.views()
    assert spark.sql("select max(id) from venues").first()[0] == 2
    c.add("t", c.frame("venues"))
    assert c.schema("t").names == ["id", "name"]
    c.clear()
    with pytest.raises(AnalysisError):
        c.frame("t")
    for bad in ("t (a float)", "t (a int key)", "t a int", "t (a)"):
        with pytest.raises((ParseError, AnalysisError)):
            parse_catalog(bad)


def test_schemas():
    a, b = schema([Type.INT], ["x"]), schema([Type.STRING], ["x"])
    assert merge(a, b).names == ["x", "x"] and field_index(merge(a, b), "x") == 0
    assert same_types(a, schema([Type.INT], ["y"])) and not same_types(a, b)
    with pytest.raises(AnalysisError):
        field_index(a, "z")
    with pytest.raises(AnalysisError):
        schema([])
