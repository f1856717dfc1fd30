"""The engine: SQL statements over a catalog and, for changes, a store of versioned tables; and its command line."""

from __future__ import annotations

import os
import sys
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog
from .errors import AnalysisError, EngineError
from .operators import values
from .plans.build import build, condition
from .plans.draw import tree
from .plans.logical import Control, Delete, Insert, Query
from .plans.parser import parse, statements
from .plans.stats import TableStats
from .storage.versioned import Store, Transaction
from .types import format_row

#: The column of the row that counts a change's rows.
COUNT = {Insert: "Number of inserted records", Delete: "Number of deleted records"}


def session(name: str = "tarn", **conf: str) -> SparkSession:
    """A session with the settings that results rely on: UTC, adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


class Engine:
    """Tables of the store can be changed; a table that is only in the catalog is read-only.

    Joins of tables that stats describes (see plans.stats.compute) are ordered by estimated cost.
    A statement outside SET TRANSACTION ... COMMIT is a transaction of its own; any error ends the open one.
    """

    def __init__(self, spark: SparkSession, store: Store | None = None, int32: bool = False, stats: dict[str, TableStats] | None = None) -> None:
        self.spark, self.store, self.int32, self.stats = spark, store, int32, stats or {}
        self.catalog = Catalog(spark)
        self.current: Transaction | None = None

    def table(self, name: str, within: Transaction | None = None) -> DataFrame:
        t = within or self.current
        if self.store and name in (t.changed.keys() | t.tables.keys() if t else set(self.store.tables())):
            return (t or self.store.begin()).read(name)
        return self.catalog.frame(name)

    def plan(self, sql: str) -> Query | Insert | Delete | Control:
        return parse(sql)

    def sql(self, sql: str) -> DataFrame | None:
        """Run one statement: a query's DataFrame (lazy), a change's count as one row, nothing for transaction control."""
        try:
            plan = parse(sql)
            if isinstance(plan, Query):
                return build(plan, self.table, self.int32, self.stats)
            if isinstance(plan, Control):
                return self._control(plan.what)
            return self._count(COUNT[type(plan)], self._change(plan))
        except BaseException:
            self._end()
            raise

    def _end(self) -> None:
        if self.current:
            self.current.rollback()
            self.current = None

    def _control(self, what: str) -> None:
        if what == "BEGIN":
            if self.current:
                raise EngineError("a transaction is open already")
            self.current = self._store().begin()
            return
        if not self.current:
            raise EngineError(f"{what} without a transaction")
        t, self.current = self.current, None
        if what == "COMMIT":
            t.commit()
        else:
            t.rollback()

    def _store(self) -> Store:
        if not self.store:
            raise EngineError("no store: tables are read-only")
        return self.store

    def _change(self, plan: Insert | Delete) -> int:
        work: Callable[[Transaction], int] = (lambda t: self._insert(plan, t)) if isinstance(plan, Insert) else (lambda t: self._delete(plan, t))
        return work(self.current) if self.current else self._store().run(work)

    def _insert(self, plan: Insert, t: Transaction) -> int:
        s = t.schema(plan.table)
        if plan.query is not None:
            return t.insert(plan.table, build(plan.query, lambda n: self.table(n, t), self.int32, self.stats))
        if len(plan.values) != len(s.fields):
            raise AnalysisError(f"{len(plan.values)} values for {len(s.fields)} columns of {plan.table}")
        for v, f in zip(plan.values, s.fields, strict=True):
            if isinstance(v, str) != isinstance(f.dataType, T.StringType):
                raise AnalysisError(f"{v!r} for column {f.name} ({f.dataType.simpleString()})")
        kinds = {int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
        row = T.StructType([T.StructField(f.name, kinds[type(v)]) for v, f in zip(plan.values, s.fields, strict=True)])
        return t.insert(plan.table, values(self.spark, plan.values, row))

    def _delete(self, plan: Delete, t: Transaction) -> int:
        return t.delete(plan.table.table, condition(plan, t.read(plan.table.table)))

    def _count(self, name: str, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], T.StructType([T.StructField(name, T.LongType())]))

    def explain(self, sql: str, stats: dict[str, TableStats] | None = None) -> str:
        """The logical tree, then Spark's physical plan."""
        plan = parse(sql)
        if not isinstance(plan, Query):
            return type(plan).__name__
        df = build(plan, self.table, self.int32, self.stats)
        return tree(plan, stats or self.stats or None) + "\n\n" + df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def render(df: DataFrame) -> str:
    """A result as text: names, a rule, a line for each row, and their number. For results that a person will read."""
    return "\n".join(lines(df))


def lines(df: DataFrame) -> Iterator[str]:
    """render()'s lines, a partition of rows at a time."""
    head, n = "\t".join(df.columns), 0
    yield head
    yield "-" * max(8, len(head.expandtabs()))
    for r in df.toLocalIterator():
        yield format_row(r)
        n += 1
    yield f" {n} rows."


def main(args: list[str]) -> int:
    """convert FILE N [TYPES [SEP]] | print FILE.dat N | split CATALOG PARTS FOLDER | parser CATALOG [-explain] [-f FILE]"""
    from .catalog import parse_catalog
    from .sources import text
    from .sources.heapfile import read_heap, split_heap
    from .types import Type, schema

    if args[:1] == ["convert"] and len(args) >= 3:
        kinds = [Type.named(t) for t in args[3].split(",")] if len(args) > 3 else None
        path, n = text.convert(args[1], int(args[2]), kinds, args[4] if len(args) > 4 else ",")
        print(f"{n} rows in {path}")
    elif args[:1] == ["print"] and len(args) == 3:
        n = int(args[2])
        for row in read_heap(session(), args[1], schema([Type.INT] * n, [f"f{i}" for i in range(n)])).toLocalIterator():
            print(format_row(row))
    elif args[:1] == ["split"] and len(args) == 4:
        for name, s, _ in parse_catalog(open(args[1]).read()):
            for path in split_heap(os.path.join(os.path.dirname(args[1]), f"{name}.dat"), s, int(args[2]), os.path.join(args[3], name)):
                print(path)
    elif args[:1] == ["parser"] and len(args) >= 2:
        engine = Engine(session())
        engine.catalog.load(args[1])
        script = open(args[args.index("-f") + 1]).read() if "-f" in args else sys.stdin.read()
        for s in statements(script):
            began = time.time()
            try:
                if "-explain" in args:
                    print(engine.explain(s))
                out = engine.sql(s)
                for line in lines(out) if out is not None else ["ok"]:
                    print(line)
            except EngineError as e:
                print(f"{type(e).__name__}: {e}")
            print(f"{time.time() - began:.2f} seconds")
    else:
        print(main.__doc__)
        return 2
    return 0
