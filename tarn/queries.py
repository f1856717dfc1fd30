"""The engine's queries over the synthetic tables, each with the SQL that gives the same result elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.aggregates import Agg, Custom
from .functions.predicates import Op
from .operators import aggregate, bloom_join, filter_rows, gather, hash_join, hash_partition, join, order_by, project, rename, scan, select_all, shuffle, subquery_join, two_phase
from .errors import TransactionAborted
from .operators.exchange import range_function
from .storage.versioned import Store, shared_root

Run = Callable[[SparkSession, str], DataFrame]
#: An aggregate that no built-in one is: the difference between the greatest and the least value.
SPREAD = Custom("SPREAD", lambda c: F.struct(F.min(c).alias("low"), F.max(c).alias("high")), lambda s: F.max(s["high"]) - F.min(s["low"]))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, store: Store | None = None) -> Engine:
    out = Engine(spark, store)
    for name in TABLES:
        out.catalog.add_parquet(name, f"{sf_dir}/{name}.parquet")
    return out


def by_sql(sql: str, *names: str) -> Run:
    """A query through the SQL front end, its columns renamed."""
    return lambda spark, sf_dir: engine(spark, sf_dir).sql(sql).toDF(*names)


def by(name: str, work: Callable[[DataFrame], DataFrame]) -> Run:
    """An operator on one table."""
    return lambda spark, sf_dir: work(table(spark, sf_dir, name))


def changed(name: str, columns: list[str], *statements: str) -> Run:
    """Statements on a copy of a table, in a store; the table afterwards."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, shared_root(spark, "dml"))
        source = table(spark, sf_dir, name).select(*columns)
        store.run(lambda t: t.create(name, source))
        e = engine(spark, sf_dir, store)
        for s in statements:
            e.sql(s)
        return e.table(name)

    return run


def two(a: str, b: str, work: Callable[[DataFrame, DataFrame], DataFrame]) -> Run:
    return lambda spark, sf_dir: work(table(spark, sf_dir, a), table(spark, sf_dir, b))


#: name -> (the engine's query, the same in standard SQL).
CATALOGUE: dict[str, tuple[Run, str]] = {
    "scan_all": (by_sql("SELECT * FROM nation", "n_nationkey", "n_name", "n_regionkey"), "SELECT * FROM nation"),
    "project_reorder": (by("nation", lambda n: project(n, [1, 0, 1], ["n_name", "n_nationkey", "n_name2"])), "SELECT n_name, n_nationkey, n_name AS n_name2 FROM nation"),
    "rename_column": (by("region", lambda r: rename(r, 0, "region_id").select("region_id", "r_name")), "SELECT r_regionkey AS region_id, r_name FROM region"),
    "filter_eq": (by_sql("SELECT p_partkey, p_size FROM part WHERE p_size = 10", "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size = 10"),
    "filter_ne": (by_sql("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey != 1", "n_nationkey", "n_regionkey"), "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 1"),
    "filter_gt": (by_sql("SELECT o_orderkey FROM orders WHERE o_custkey > 1000", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey > 1000"),
    "filter_ge": (by_sql("SELECT o_orderkey FROM orders WHERE o_custkey >= 1000", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey >= 1000"),
    "filter_lt": (by_sql("SELECT o_orderkey FROM orders WHERE o_custkey < 100", "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey < 100"),
    "filter_le": (by("orders", lambda o: filter_rows(o, "o_custkey", Op.LESS_THAN_OR_EQ, 100).select("o_orderkey")), "SELECT o_orderkey FROM orders WHERE o_custkey <= 100"),
    "filter_str_eq": (by_sql("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'", "c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_str_gt": (by_sql("SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_2'", "n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_2'"),
    "filter_contains": (by_sql("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment LIKE 'UIL'", "c_custkey", "c_mktsegment"), "SELECT c_custkey, c_mktsegment FROM customer WHERE contains(c_mktsegment, 'UIL')"),
    "filter_contains_literal_pct": (by_sql("SELECT doc_id FROM documents WHERE text ~ '%'", "doc_id"), "SELECT doc_id FROM documents WHERE contains(text, '%')"),
    "filter_like_int": (by_sql("SELECT p_partkey FROM part WHERE p_size LIKE 10", "p_partkey"), "SELECT p_partkey FROM part WHERE p_size = 10"),
    "filter_and": (by_sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND (l_linenumber < 4 AND l_returnflag = 'R')", "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 2 AND l_linenumber < 4 AND l_returnflag = 'R'"),
    "filter_const_left": (by_sql("SELECT p_partkey FROM part WHERE 40 < p_size", "p_partkey"), "SELECT p_partkey FROM part WHERE 40 < p_size"),
    "join_equi": (by_sql("SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey", "o_orderkey", "c_name"), "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"),
    "join_hash": (two("orders", "customer", lambda o, c: hash_join(o, c, "o_custkey", "c_custkey").select("o_orderkey", "c_name")), "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey"),
    "join_theta_lt": (by_sql("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey < n.n_regionkey", "r_name", "n_name"), "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey < n.n_regionkey"),
    "join_theta_ne": (by_sql("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey <> n.n_regionkey", "r_name", "n_name"), "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey <> n.n_regionkey"),
    "join_contains": (two("nation", "region", lambda n, r: join(n, r.selectExpr("*", "substring(r_name, 1, 1) AS initial"), [("n_name", Op.LIKE, "initial")]).selectExpr("n_name AS outer_name", "r_name AS inner_name")), "SELECT a.n_name AS outer_name, b.r_name AS inner_name FROM nation a, region b WHERE contains(a.n_name, substring(b.r_name, 1, 1))"),
    "join_self": (by_sql("SELECT a.n_name, b.n_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey", "a_name", "b_name"), "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey"),
    "join_star": (by_sql("SELECT * FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey", "r_regionkey", "r_name", "n_nationkey", "n_name", "n_regionkey"), "SELECT r.r_regionkey, r.r_name, n.n_nationkey, n.n_name, n.n_regionkey FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey"),
    "join_multiway": (
        by_sql("SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey", "l_orderkey", "l_linenumber", "c_name", "n_name"),
        "SELECT l.l_orderkey, l.l_linenumber, c.c_name, n.n_name FROM lineitem l, orders o, customer c, nation n WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey",
    ),
    "join_two_predicates": (by_sql("SELECT a.n_nationkey, b.n_nationkey FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", "ak", "bk"), "SELECT a.n_nationkey AS ak, b.n_nationkey AS bk FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"),
    "join_subquery": (by_sql("SELECT * FROM orders o WHERE o.o_custkey = (SELECT c_custkey FROM customer WHERE c_nationkey = 3)", *(f"c{i}" for i in range(6)), "sub_key"), "SELECT o.o_orderkey AS c0, o.o_custkey AS c1, o.o_orderstatus AS c2, o.o_totalprice AS c3, o.o_orderdate AS c4, o.o_orderpriority AS c5, s.k AS sub_key FROM orders o JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3) s ON o.o_custkey = s.k"),
    "join_subquery_operator": (two("orders", "customer", lambda o, c: subquery_join(o, "o_custkey", Op.EQUALS, project(filter_rows(c, "c_nationkey", Op.EQUALS, 3), ["c_custkey"], ["sub_key"])).select("o_orderkey", "sub_key")), "SELECT o.o_orderkey, s.k AS sub_key FROM orders o JOIN (SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3) s ON o.o_custkey = s.k"),
    "filter_inference": (by_sql("SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_custkey < 50", "o_orderkey", "c_name"), "SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_custkey < 50"),
    "join_runtime_filter": (two("lineitem", "part", lambda li, p: bloom_join(li, "l_partkey", filter_rows(p, "p_size", Op.EQUALS, 1), "p_partkey", force=True).select("l_orderkey", "l_linenumber")), "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l, part p WHERE l.l_partkey = p.p_partkey AND p.p_size = 1"),
    "agg_min": (by_sql("SELECT min(o_custkey) FROM orders", "v"), "SELECT min(o_custkey) AS v FROM orders"),
    "agg_max": (by_sql("SELECT max(o_custkey) FROM orders", "v"), "SELECT max(o_custkey) AS v FROM orders"),
    "agg_sum": (by_sql("SELECT sum(o_custkey) FROM orders", "v"), "SELECT CAST(sum(o_custkey) AS BIGINT) AS v FROM orders"),
    "agg_avg_int": (by_sql("SELECT avg(o_custkey) FROM orders", "v"), "SELECT CAST(sum(o_custkey) // count(o_custkey) AS BIGINT) AS v FROM orders"),
    "agg_count_int": (by_sql("SELECT count(o_custkey) FROM orders", "v"), "SELECT count(o_custkey) AS v FROM orders"),
    "agg_count_string": (by_sql("SELECT count(c_mktsegment) FROM customer", "v"), "SELECT count(c_mktsegment) AS v FROM customer"),
    "agg_empty_global": (by_sql("SELECT count(o_custkey) FROM orders WHERE o_custkey < 0", "v"), "SELECT count(o_custkey) AS v FROM orders WHERE o_custkey < 0 HAVING count(*) > 0"),
    "agg_sum_int32": (by("orders", lambda o: aggregate(o, "o_orderkey", Agg.SUM, name="v", int32=True).selectExpr("CAST(v AS BIGINT) AS v")), "SELECT CAST((CAST(sum(o_orderkey) AS BIGINT) + 2147483648) % 4294967296 - 2147483648 AS BIGINT) AS v FROM orders"),
    "group_int_key": (by_sql("SELECT c_nationkey, count(c_custkey) FROM customer GROUP BY c_nationkey", "c_nationkey", "v"), "SELECT c_nationkey, count(c_custkey) AS v FROM customer GROUP BY c_nationkey"),
    "group_string_key": (by_sql("SELECT c_mktsegment, max(c_custkey) FROM customer GROUP BY c_mktsegment", "c_mktsegment", "v"), "SELECT c_mktsegment, max(c_custkey) AS v FROM customer GROUP BY c_mktsegment"),
    "group_avg_int": (by_sql("SELECT l_returnflag, avg(l_linenumber) FROM lineitem GROUP BY l_returnflag", "l_returnflag", "v"), "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag"),
    "group_sum_count": (by("lineitem", lambda li: aggregate(li, "l_linenumber", Agg.SUM_COUNT, "l_returnflag", "x").selectExpr("l_returnflag", "x.sum AS s", "x.count AS c")), "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, count(l_linenumber) AS c FROM lineitem GROUP BY l_returnflag"),
    "group_two_phase_avg": (by("lineitem", lambda li: two_phase(li.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_linenumber", Agg.AVG, "l_returnflag", "v")), "SELECT l_returnflag, CAST(sum(l_linenumber) // count(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag"),
    "group_two_phase_count": (by("lineitem", lambda li: two_phase(li.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_linenumber", Agg.COUNT, "l_returnflag", "v")), "SELECT l_returnflag, count(l_linenumber) AS v FROM lineitem GROUP BY l_returnflag"),
    "partition_hash": (by("customer", lambda c: aggregate(hash_partition(c, "c_custkey", 4), "c_custkey", Agg.COUNT, "part_id", "v")), "SELECT c_custkey % 4 AS part_id, count(c_custkey) AS v FROM customer GROUP BY c_custkey % 4"),
    "shuffle_group": (by("orders", lambda o: aggregate(shuffle(o, "o_custkey", 8), "o_orderkey", Agg.MAX, "o_custkey", "v")), "SELECT o_custkey, max(o_orderkey) AS v FROM orders GROUP BY o_custkey"),
    "order_by_asc": (by_sql("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey", "n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey"),
    "order_by_desc": (by("nation", lambda n: order_by(n, "n_name", False).select("n_nationkey", "n_name")), "SELECT n_nationkey, n_name FROM nation ORDER BY n_name DESC"),
    "order_by_unprojected": (by_sql("SELECT n_name FROM nation ORDER BY n_nationkey DESC", "n_name"), "SELECT n_name FROM nation ORDER BY n_nationkey DESC"),
    "insert_select": (changed("region", ["r_regionkey", "r_name"], "INSERT INTO region SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1"),
    "insert_values": (changed("region", ["r_regionkey", "r_name"], "INSERT INTO region VALUES (99, 'ATLANTIS')"), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(99 AS INTEGER), 'ATLANTIS'"),
    "delete_where": (changed("nation", ["n_nationkey", "n_name", "n_regionkey"], "DELETE FROM nation WHERE n_regionkey = 1"), "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 1)"),
    "transaction_commit": (changed("region", ["r_regionkey", "r_name"], "SET TRANSACTION READ WRITE", "INSERT INTO region VALUES (98, 'MU')", "DELETE FROM region WHERE r_regionkey = 0", "COMMIT"), "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT CAST(98 AS INTEGER), 'MU'"),
    "transaction_rollback": (changed("region", ["r_regionkey", "r_name"], "SET TRANSACTION READ WRITE", "DELETE FROM region", "ROLLBACK"), "SELECT r_regionkey, r_name FROM region"),
    "scan_alias": (by("supplier", lambda s: select_all(scan(s, "s")).toDF(*s.columns)), "SELECT * FROM supplier"),
    "flagship": (
        by_sql("SELECT c.c_mktsegment, count(o.o_orderkey) FROM orders o, customer c WHERE o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY c.c_mktsegment", "c_mktsegment", "v"),
        "SELECT c.c_mktsegment, count(o.o_orderkey) AS v FROM orders o, customer c WHERE o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment ORDER BY c.c_mktsegment",
    ),
}


def heap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, written as a paged file and read back."""
    from .sources.heapfile import read_heap, write_heap

    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = shared_root(spark, "heap")
    write_heap(n, path)
    return read_heap(spark, path, n.schema)


CATALOGUE["heap_scan"] = (heap_scan, "SELECT n_nationkey, n_name, n_regionkey FROM nation")


def stored(name: str, columns: list[str], work: Callable[[SparkSession, Store], Store]) -> Run:
    """A copy of a table in a store, what work does to it, and the table as the store that comes back has it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Store(spark, shared_root(spark, "stored"))
        store.run(lambda t: t.create(name, table(spark, sf_dir, name).select(*columns)))
        return work(spark, store).table(name)

    return run


def conflict(spark: SparkSession, store: Store) -> Store:
    """Two transactions delete different rows of one snapshot: the second to commit is aborted, and leaves nothing."""
    a, b = store.begin(), store.begin()
    a.delete("region", F.col("r_regionkey") == 0)
    b.delete("region", F.col("r_regionkey") == 1)
    a.commit()
    try:
        b.commit()
    except TransactionAborted:
        return store
    raise AssertionError("the second transaction was not aborted")


def checkpoint(spark: SparkSession, store: Store) -> Store:
    """Two changes, a checkpoint that forgets the versions before, and one change more."""
    for key in (0, 1):
        store.run(lambda t, key=key: t.delete("region", F.col("r_regionkey") == key))
    store.checkpoint()
    store.run(lambda t: t.delete("region", F.col("r_regionkey") == 2))
    return store


def recovery(spark: SparkSession, store: Store) -> Store:
    """A committed change, one that a crash left without commit, and the store opened again and recovered."""
    store.run(lambda t: t.delete("region", F.col("r_regionkey") == 0))
    store.begin().delete("region", F.col("r_regionkey") == 1)
    again = Store(spark, store.root)
    again.recover()
    return again


def compaction(spark: SparkSession, store: Store) -> Store:
    """Three changes that leave folders, which are then one."""
    for key in (2, 3):
        store.run(lambda t, key=key: t.insert("region", t.read("region").where(F.col("r_regionkey") == key)))
    store.run(lambda t: t.compact("region"))
    return store


REGION = ["r_regionkey", "r_name"]
CATALOGUE["conflict_abort"] = (stored("region", REGION, conflict), "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
CATALOGUE["checkpoint"] = (stored("region", REGION, checkpoint), "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2")
CATALOGUE["recovery"] = (stored("region", REGION, recovery), "SELECT r_regionkey, r_name FROM region WHERE r_regionkey <> 0")
CATALOGUE["compaction"] = (stored("region", REGION, compaction), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey IN (2, 3)")


def text_and_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as delimited text, loaded into a paged file beside a catalog in text form; then a query over that catalog."""
    from .sources.heapfile import write_heap
    from .sources.text import load_text
    from .types import Type, schema

    root = shared_root(spark, "catalog")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.write.csv(f"{root}/text")
    s = schema([Type.INT, Type.STRING, Type.INT], n.columns)
    local = root.removeprefix("file://")
    write_heap(load_text(spark, f"{root}/text", s), f"{local}/nation.dat")
    with open(f"{local}/catalog.txt", "w") as f:
        f.write("nation (n_nationkey int pk, n_name string, n_regionkey int)\n")
    e = Engine(spark)
    e.catalog.load(f"{local}/catalog.txt")
    return e.sql("SELECT n.n_nationkey, n.n_name FROM nation n WHERE n.n_regionkey = 1").toDF("n_nationkey", "n_name")


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a logical plan, as EXPLAIN draws it."""
    e = engine(spark, sf_dir)
    tree = e.explain("SELECT c.c_name FROM customer c, nation n WHERE c.c_nationkey = n.n_nationkey AND n.n_regionkey = 1").split("\n\n")[0]
    return spark.createDataFrame(list(enumerate(tree.splitlines())), "number int, line string")


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of four tables in the order that statistics of them suggest."""
    from .plans.stats import compute

    e = engine(spark, sf_dir)
    e.stats = {t: compute(table(spark, sf_dir, t)) for t in ("orders", "customer", "nation", "region")}
    sql = "SELECT o.o_orderkey, r.r_name FROM orders o, customer c, nation n, region r WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_regionkey = 2"
    return e.sql(sql).toDF("o_orderkey", "r_name")


CATALOGUE["text_and_catalog"] = (text_and_catalog, "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
CATALOGUE["explain_tree"] = (
    explained,
    "SELECT * FROM (VALUES (CAST(0 AS INTEGER), 'π(c.c_name)'), (1, '└─⨝(c.c_nationkey = n.n_nationkey)'), (2, '  ├─ρ(c) scan customer'), (3, '  └─σ(n.n_regionkey = 1)'), (4, '    └─ρ(n) scan nation')) t(number, line)",
)
CATALOGUE["join_ordered"] = (ordered, "SELECT o.o_orderkey, r.r_name FROM orders o, customer c, nation n, region r WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_regionkey = 2")
CATALOGUE["gather"] = (by("customer", lambda c: aggregate(gather(c.select("c_custkey", "c_nationkey")).withColumn("part", F.spark_partition_id()), "c_custkey", Agg.COUNT, "part", "v").select("v")), "SELECT count(*) AS v FROM customer")
CATALOGUE["partition_string"] = (
    by("customer", lambda c: hash_partition(c, "c_mktsegment", 4).groupBy("c_mktsegment").agg(F.count_distinct("part_id").alias("parts"), F.min((F.col("part_id") >= 0) & (F.col("part_id") < 4)).alias("inside"))),
    "SELECT c_mktsegment, CAST(1 AS BIGINT) AS parts, true AS inside FROM customer GROUP BY c_mktsegment",
)
CATALOGUE["partition_range"] = (
    by("customer", lambda c: aggregate(hash_partition(c, "c_custkey", 3, by=range_function([100, 1000])), "c_custkey", Agg.COUNT, "part_id", "v").selectExpr("CAST(part_id AS INT) AS part_id", "v")),
    "SELECT CAST(CASE WHEN c_custkey < 100 THEN 0 WHEN c_custkey < 1000 THEN 1 ELSE 2 END AS INTEGER) AS part_id, count(*) AS v FROM customer GROUP BY 1",
)
CATALOGUE["group_custom"] = (
    by("lineitem", lambda li: two_phase(li.select("l_returnflag", "l_linenumber"), "l_linenumber", SPREAD, "l_returnflag", "v")),
    "SELECT l_returnflag, max(l_linenumber) - min(l_linenumber) AS v FROM lineitem GROUP BY l_returnflag",
)
CATALOGUE["join_like_turned"] = (
    by_sql("SELECT a.n_name, b.r_name FROM nation a, region b WHERE a.n_regionkey = b.r_regionkey AND b.r_name LIKE a.n_name", "n_name", "r_name"),
    "SELECT a.n_name, b.r_name FROM nation a, region b WHERE a.n_regionkey = b.r_regionkey AND contains(b.r_name, a.n_name)",
)
