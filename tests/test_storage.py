"""Versioned tables: visibility, conflicts, recovery; and transactions in SQL."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from tarn.engine import Engine
from tarn.errors import AnalysisError, EngineError, TransactionAborted
from tarn.operators import rows
from tarn.storage.versioned import Store
from tarn.types import Type, schema

INTS = schema([Type.INT, Type.INT], ["a", "b"])


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    s.run(lambda t: t.create("t", rows(spark, [(1, 10), (2, 20)], INTS)))
    return s


def test_delete_rewrites_only_folders_that_it_hits(spark, store):
    store.run(lambda t: t.insert("t", rows(spark, [(3, 30), (4, 40)], INTS)))
    before = store.manifest()["tables"]["t"]["folders"]
    assert store.run(lambda t: t.delete("t", F.col("a") == 4)) == 1
    after = store.manifest()["tables"]["t"]["folders"]
    assert after[0] == before[0] and after[1] != before[1] and got(store.table("t")) == [(1, 10), (2, 20), (3, 30)]
    assert store.run(lambda t: t.delete("t", F.col("a") == 99)) == 0
    assert store.manifest()["tables"]["t"]["folders"] == after
    assert store.run(lambda t: t.compact("t")) == 2 and len(store.manifest()["tables"]["t"]["folders"]) == 1
    assert got(store.table("t")) == [(1, 10), (2, 20), (3, 30)]


def test_opening_recovers(spark, store):
    import time

    left = store.begin()
    left.insert("t", rows(spark, [(9, 9)], INTS))  # never ended, as after a crash
    folder = os.path.join(store.root, "data", left.staged[0])
    Store(spark, store.root)
    assert os.path.isdir(folder)  # it might still be running
    long_ago = time.time() - 30 * 86400
    os.utime(folder, (long_ago, long_ago))
    assert got(Store(spark, store.root).table("t")) == [(1, 10), (2, 20)] and not os.path.isdir(folder)


def test_any_hadoop_file_system(spark, tmp_path):
    """The same store by Hadoop's interfaces."""
    from tarn.storage import files

    f = files.HadoopFiles(spark, f"file://{tmp_path}/db")
    f.make("log")
    assert f.create_new("log/1.json", "é{}") and not f.create_new("log/1.json", "no") and f.read("log/1.json") == "é{}"
    assert f.names("log") == ["1.json"] and f.names("log", 1000) == [] and f.size("log") == 4
    f.delete("log/1.json")
    with pytest.raises(FileNotFoundError):
        f.read("log/1.json")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tarn.link./db", f"file://{tmp_path}")
    s = Store(spark, "viewfs://tarn/db/store")
    assert isinstance(s.files, files.HadoopFiles)
    s.run(lambda t: t.create("t", rows(spark, [(1, 10), (2, 20)], INTS)))
    s.run(lambda t: t.insert("t", rows(spark, [(3, 30)], INTS)))
    assert s.run(lambda t: t.delete("t", F.col("a") == 2)) == 1 and got(s.table("t")) == [(1, 10), (3, 30)]
    a, b = s.begin(), s.begin()
    a.delete("t")
    b.insert("t", rows(spark, [(5, 5)], INTS))
    a.commit()
    with pytest.raises(TransactionAborted):
        b.commit()
    assert s.checkpoint() == 4 and got(s.table("t")) == []


def test_commit_and_rollback(spark, store):
    t = store.begin()
    assert t.insert("t", rows(spark, [(6, 830)], INTS)) == 1
    assert (6, 830) in got(t.read("t")) and (6, 830) not in got(store.table("t"))
    t.commit()
    assert (6, 830) in got(store.table("t"))
    t = store.begin()
    t.delete("t")
    t.rollback()
    assert len(got(store.table("t"))) == 3
    with pytest.raises(EngineError):
        t.read("t")


def test_conflicts_abort(spark, store):
    a, b = store.begin(), store.begin()
    a.insert("t", rows(spark, [(7, 7)], INTS))
    b.insert("t", rows(spark, [(8, 8)], INTS))
    a.commit()
    with pytest.raises(TransactionAborted):
        b.commit()
    assert (8, 8) not in got(store.table("t"))


def test_reads_count_for_conflicts_and_other_tables_do_not(spark, store):
    store.run(lambda t: t.create("u", rows(spark, [], INTS)))
    a, b, c = store.begin(), store.begin(), store.begin()
    a.read("t")
    a.insert("u", rows(spark, [(0, 0)], INTS))
    c.create("w", rows(spark, [(5, 5)], INTS))
    b.insert("t", rows(spark, [(9, 9)], INTS))
    b.commit()
    c.commit()  # it has touched neither
    with pytest.raises(TransactionAborted):
        a.commit()
    assert store.tables() == ["t", "u", "w"] and got(store.table("u")) == []


@pytest.mark.parametrize("n", [1, 2, 5])
def test_increments(spark, store, n):
    store.run(lambda t: t.create("c", rows(spark, [(0, 0)], INTS)))

    def add(t):
        value = t.read("c").first()["a"]
        t.delete("c")
        t.insert("c", rows(spark, [(value + 1, 0)], INTS))

    threads = [threading.Thread(target=lambda: store.run(add)) for _ in range(n)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert got(store.table("c")) == [(n, 0)]


def test_crashes(spark, store, tmp_path):
    lost = store.begin()
    lost.insert("t", rows(spark, [(42, 42)], INTS))  # and the process ends here
    with open(tmp_path / "db" / "log" / "x.draft", "w") as f:
        f.write("{")
    done = store.begin()
    done.insert("t", rows(spark, [(3, 30)], INTS))
    done.commit()
    again = Store(spark, store.root)
    assert len(again.recover()) == 1
    assert got(again.table("t")) == [(1, 10), (2, 20), (3, 30)]
    assert again.checkpoint() == 2 and got(again.table("t")) == [(1, 10), (2, 20), (3, 30)]
    assert len(os.listdir(tmp_path / "db" / "log")) == 1
    again.run(lambda t: t.delete("t"))
    assert got(Store(spark, store.root).table("t")) == []


def test_types_nulls_and_cuts(spark, store):
    store.run(lambda t: t.create("s", rows(spark, [("x" * 200, 1), (None, 2)], schema([Type.STRING, Type.INT], ["s", "n"]))))
    store.run(lambda t: t.insert("s", rows(spark, [("y" * 200, 3)], schema([Type.STRING, Type.INT], ["s", "n"])), compat=True))
    assert sorted(len(r.s or "") for r in store.table("s").collect()) == [0, 128, 200]
    assert store.run(lambda t: t.delete("s", F.col("s") == "z")) == 0
    assert store.run(lambda t: t.delete("s", F.col("s").startswith("x"))) == 1  # the null stays
    with pytest.raises(AnalysisError):
        store.run(lambda t: t.insert("s", rows(spark, [(1, 1)], INTS)))
    with pytest.raises(AnalysisError):
        store.table("none")


def test_sql_changes(spark, store):
    e = Engine(spark, store)
    e.catalog.add("more", rows(spark, [(5, 50), (6, 60)], INTS))
    out = e.sql("INSERT INTO t SELECT a, b FROM more WHERE a > 5")
    assert out.columns == ["Number of inserted records"] and got(out) == [(1,)]
    assert got(e.sql("insert into t values (7, 70)")) == [(1,)]
    assert got(e.sql("delete from t where a >= 6 and b < 100")) == [(2,)]
    e.sql("set transaction read write")
    e.sql("delete from t")
    assert got(e.sql("select a from t")) == [] and len(got(store.table("t"))) == 2
    e.sql("rollback")
    assert got(e.sql("select a from t")) == [(1,), (2,)]
    e.sql("set transaction read write")
    e.sql("insert into t values (9, 9)")
    with pytest.raises(AnalysisError):
        e.sql("insert into t values ('x', 9)")  # and the transaction with it
    with pytest.raises(EngineError):
        e.sql("commit")
    assert (9, 9) not in got(store.table("t"))
    for bad in ("insert into t values (1)", "insert into more values (1, 2)", "delete from t where c = 1"):
        with pytest.raises(EngineError):
            e.sql(bad)
    with pytest.raises(EngineError):
        Engine(spark).sql("insert into t values (1, 2)")
