"""Connected components of an edge table: of a small one in one task, of others by alternating stars; nothing goes to the
driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, dropped, keyed_join, tidy, written

#: Edges that one task takes at most, and bytes of their ends; types that Arrow orders as Spark does.
ONE_TASK, ONE_TASK_BYTES = 1 << 20, 64 << 20
ORDERED = {"binary", "string", "tinyint", "smallint", "int", "bigint", "date"}


def mark(edges: DataFrame) -> tuple:
    """The same for equal sets of edges, and for no others but by a chance of 2 ** -64."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), of any type that has an order -> (node, root) for each node, root the least node of its component.

    A round costs some ten exchanges, each of as many tasks as there are shuffle partitions, whatever the number of
    edges; so up to ONE_TASK edges (ONE_TASK_BYTES of ends) go to one task, which needs none. More take rounds, which
    join every node's larger neighbours to its least one, then every node and its smaller
    neighbours to the least of these (large and small star), until nothing changes. Minima are combined
    before rows are exchanged and joined back, so no node's neighbours are gathered; each round's edges
    are a table in the shared folder, so a lost executor costs one round. Nulls and loops are ignored;
    no edges: no rows.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if fits(e):
        kind = e.schema["a"].dataType.simpleString()
        return e.coalesce(1).mapInArrow(lone, f"node {kind}, root {kind}")
    marks = mark(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = written(joined(both, low, marks[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = joined(large, least, marks[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*")
        new = written(small.where("a <> b").distinct(), "edges")
        dropped(e)
        dropped(large)
        e, before, marks = new, marks, mark(new)
        if marks == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def joined(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """edges and, for each a, its m; a's that many of the n edges have are joined apart."""
    return keyed_join(edges, least, "a", edges.groupBy("a").count()) if n >= HOT_ROWS else edges.join(least, "a")


def fits(edges: DataFrame) -> bool:
    """Whether one task takes all edges."""
    kind = edges.schema["a"].dataType.simpleString()
    if kind not in ORDERED:
        return False
    long = F.octet_length("a") + F.octet_length("b") if kind in ("binary", "string") else F.lit(16)
    n, size = edges.agg(F.count("*"), F.coalesce(F.sum(long.cast("long")), F.lit(0))).first()
    return n <= ONE_TASK and size <= ONE_TASK_BYTES


def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) -> node, root."""
    held = [b for b in batches if b.num_rows]
    if held:
        ends = pa.chunked_array([b.column(i) for i in (0, 1) for b in held])
        nodes = pc.unique(ends)
        nodes = nodes.take(pc.sort_indices(nodes))
        number = pc.index_in(ends, value_set=nodes).to_numpy().astype(np.int64)
        yield from pa.table([nodes, nodes.take(pa.array(roots(*np.split(number, 2), len(nodes))))], ["node", "root"]).to_batches(1 << 14)
    tidy()


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Edges of numbers below n -> the least number of each one's component. Each pass hangs every root that has a smaller
    neighbour under one, so at most half of those with neighbours are left."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root
