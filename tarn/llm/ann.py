"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors are dealt to shards by a hash of id and components (and by length of vector: those of other lengths are no
neighbours). Shards have LEAST_SHARD vectors on average until there are SHARDS of them, then grow with the table
up to MOST_SHARD, so that a query of a larger table does not search more of them at first. A shard's graph is built
by insertion in the order of ids, levels drawn from the hash, and stored as one row of flat arrays: vectors, ids,
and for each node and level a block of neighbour numbers. Equal vectors are one node that lists its ids. Queries are
a table as well, a row for each block of about QUERIES: tasks pair its partitions with the index's, so neither is
copied, exchanged or sent through the driver; each block meets each shard's row, so a shard is moved once for
thousands of queries, and the shards' nearest are merged by a window that keeps only the best.

Distances are Euclidean. The search itself runs in single precision on shard vectors; what it returns is
ranked by double-precision distances of the original vectors, ties to the smaller id.

Defined cases: vectors that are null, zero or hold null or non-finite components, and rows with a null
id, take no part, neither as queries nor as candidates; a row is not its own neighbour, but other rows
with an equal vector are; no row is a neighbour of a query of its id. Repeated ids: rows of a query's id are one
query, near to what is near to any of its vectors, and a neighbour's id stands once, with its nearest vector. With
fewer candidates than asked for, all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a shard, on average: of small tables, and at most; shards before they grow; queries in a block.
LEAST_SHARD, MOST_SHARD, SHARDS, QUERIES = 2048, 8192, 24, 4096
#: Links of a node (twice as many on the bottom level); candidates held while building and while searching (more of them,
#: by the root of its size, in a shard of more than LEAST_SHARD).
LINKS, EF_BUILD, EF_SEARCH = 12, 64, 96


class Graph:
    """Flat arrays: vectors (n, d), level of each node, links[level] (n, width) of node numbers, -1 where none."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray], entry: int) -> None:
        self.vectors, self.levels, self.links, self.entry = vectors, levels, links, entry
        self.squares = np.einsum("ij,ij->i", vectors, vectors)

    def far(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances less the query's own square, which orders alike."""
        return self.squares[nodes] - 2 * (self.vectors[nodes] @ q)

    def search(self, q: np.ndarray, level: int, start: list[tuple[float, int]], ef: int) -> list[tuple[float, int]]:
        """The ef nearest found on a level from the start nodes, by distance."""
        links = self.links[level]
        seen = np.zeros(len(links), bool)
        seen[[i for _, i in start]] = True
        todo, best = list(start), [(-d, -i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            near = links[i]
            near = near[near >= 0]
            near = near[~seen[near]]
            if not len(near):
                continue
            seen[near] = True
            ds = self.far(q, near)
            if len(best) >= ef:
                ok = ds < -best[0][0]
                near, ds = near[ok], ds[ok]
            for x, j in zip(ds.tolist(), near.tolist(), strict=True):
                if len(best) < ef:
                    heapq.heappush(best, (-x, -j))
                elif x < -best[0][0]:
                    heapq.heapreplace(best, (-x, -j))
                else:
                    continue
                heapq.heappush(todo, (x, j))
        return sorted((-d, -i) for d, i in best)

    def descend(self, q: np.ndarray, to: int) -> list[tuple[float, int]]:
        at = [(float(self.far(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(int(self.levels[self.entry]), to, -1):
            at = self.search(q, level, at, 1)
        return at

    def nearest(self, q: np.ndarray, k: int, ef: int) -> np.ndarray:
        found = self.search(q, 0, self.descend(q, 0), max(k, ef))
        return np.array([i for _, i in found], np.int64)


def spread(graph: Graph, node: int, found: list[tuple[float, int]], width: int) -> list[int]:
    """Of candidates by distance, those nearer to the node than to any already taken; then the rest, up to width."""
    ids = np.array([i for _, i in found])
    v = graph.vectors[ids]
    own = graph.squares[ids] + graph.squares[node] - 2 * (v @ graph.vectors[node])
    between = graph.squares[ids][:, None] + graph.squares[ids][None, :] - 2 * (v @ v.T)
    taken: list[int] = []
    least = np.full(len(ids), np.inf, np.float32)
    for x in range(len(ids)):
        if own[x] < least[x]:
            taken.append(x)
            least = np.minimum(least, between[x])
            if len(taken) == width:
                break
    if len(taken) < width:
        held = set(taken)
        taken += [x for x in range(len(ids)) if x not in held][: width - len(taken)]
    return ids[taken].tolist()


def build(vectors: np.ndarray, draws: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """vectors (n, d) float32, at least one; draws: a number in (0, 1] for each, from which its level follows."""
    n = len(vectors)
    levels = np.minimum(np.floor(-np.log(draws) / math.log(links)), 12).astype(np.int8)
    width = lambda level: links * (2 if level == 0 else 1)
    g = Graph(vectors, levels, [np.full((n, width(x)), -1, np.int32) for x in range(int(levels.max()) + 1)], 0)
    for i in range(1, n):
        q, top = vectors[i], int(levels[i])
        at = g.descend(q, top) if int(levels[g.entry]) > top else [(float(g.far(q, np.array([g.entry]))[0]), g.entry)]
        for level in range(min(top, int(levels[g.entry])), -1, -1):
            at = g.search(q, level, at, ef)
            w = width(level)
            for j in (mine := spread(g, i, at, links)):
                theirs = g.links[level][j]
                free = int((theirs >= 0).sum())
                if free < w:
                    theirs[free] = i
                else:
                    all_ = np.append(theirs, i)
                    d = g.squares[all_] - 2 * (vectors[all_] @ vectors[j])
                    order = np.argsort(d, kind="stable")
                    theirs[:] = spread(g, j, list(zip(d[order].tolist(), all_[order].tolist(), strict=True)), w)
            g.links[level][i, : len(mine)] = mine
        if top > int(levels[g.entry]):
            g.entry = i
    return g


INDEX = "shard int, dim int, n int, entry int, vectors binary, originals binary, levels binary, links array<binary>, starts binary, ids binary"


def shard_row(rows: pa.Table) -> pa.Table:
    """The rows (shard, dim, vec_id, vector) of a shard -> its row of the index."""
    shard, dim = rows.column("shard")[0].as_py(), rows.column("dim")[0].as_py()
    ids = rows.column("vec_id").to_numpy()
    v = rows.column("vector").combine_chunks()
    v = v.flatten().to_numpy().reshape(-1, dim)
    order = np.lexsort((*v.T[::-1], ids))
    ids, v = ids[order], v[order]
    distinct, first, which = np.unique(v, axis=0, return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))  # nodes in the order of their least id
    node = rank[which.ravel()]
    distinct = distinct[np.argsort(first)]
    by = np.lexsort((ids, node))
    starts = np.append(np.searchsorted(node[by], np.arange(len(distinct))), len(by)).astype(np.int32)
    draws = np.random.default_rng(shard + 1).random(len(distinct)) * (1 - 1e-12) + 1e-12
    # Centred, single-precision vectors make the graph; a shift changes no distance.
    small = (distinct - distinct.mean(axis=0)).astype(np.float32)
    g = build(small, draws)
    row = {"shard": shard, "dim": dim, "n": len(distinct), "entry": g.entry, "vectors": small.tobytes(), "originals": distinct.tobytes(), "levels": g.levels.tobytes(), "links": [x.tobytes() for x in g.links], "starts": starts.tobytes(), "ids": ids[by].astype("<i8").tobytes()}
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    return pa.table([pa.array([x], t) for x, t in zip(row.values(), kinds, strict=True)], list(row))


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """vec_id, vector (array of double), dim: the rows that take part."""
    v = F.transform(vec, lambda x: x.cast("double"))
    df = vectors.select("vec_id", v.alias("vector")).where(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(fine & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def index(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vectors (vec_id, vec) -> the index, a row for each shard, as a table in the shared folder."""
    df = usable(vectors, vec).distinct()  # a repeated row says nothing new
    n = df.count()
    shards = max(1, math.ceil(n / min(MOST_SHARD, max(LEAST_SHARD, math.ceil(n / SHARDS)))))
    # By id and vector, so that neither an id nor a vector that many rows share makes a large shard.
    dealt = df.withColumn("shard", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard", "dim").applyInArrow(shard_row, INDEX), "ann-index")


def search(spark_index: DataFrame, queries: DataFrame, vec: str = "embedding", k: int = 10, ef: int = EF_SEARCH) -> DataFrame:
    """index(), queries (vec_id, vec) -> query_id, rank, vec_id, score of the k nearest rows of other ids."""
    q = usable(queries, vec).distinct()
    blocks = max(1, math.ceil(q.count() / QUERIES))
    packed = q.groupBy("dim", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("vec_id", "vector")).alias("queries"))
    # Each block meets every shard, as pairs of partitions of two tables: no block is copied for each shard. Copies would also
    # be of unknown size to the planner, which would broadcast many times its threshold through the driver.
    packed = written(packed.drop("block"), "ann-queries")
    pairs = spark_index.join(packed.hint("shuffle_replicate_nl"), "dim")
    pairs = pairs.select("dim", "n", "entry", "vectors", "originals", "levels", "links", "starts", "ids", F.col("queries.vec_id").alias("query_ids"), F.flatten("queries.vector").alias("query_vectors"))

    least = LEAST_SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                dim, n = x["dim"].as_py(), x["n"].as_py()
                of = lambda c, t: np.frombuffer(x[c].as_buffer(), t)  # noqa: B023, E731
                small, original = of("vectors", "<f4").reshape(n, dim), of("originals", "<f8").reshape(n, dim)
                links = [np.frombuffer(y.as_buffer(), "<i4").reshape(n, -1) for y in x["links"]]
                starts, ids = of("starts", "<i4"), of("ids", "<i8")
                wide = math.ceil(ef * max(1.0, math.sqrt(n / least)))
                g = Graph(small, of("levels", "i1"), links, x["entry"].as_py())
                centre = original[0] - small[0]
                out: tuple[list, list, list] = ([], [], [])
                # Rows that repeat an id may stand before others: as many more nodes and ids are looked at.
                more = int(np.unique(ids, return_counts=True)[1].max())
                for qid, v in zip(x["query_ids"].as_py(), x["query_vectors"].values.to_numpy(zero_copy_only=False).reshape(-1, dim), strict=True):
                    reach = (k + 1) * more
                    near = g.nearest((v - centre).astype(np.float32), reach, wide)
                    d = np.sqrt(((original[near] - v) ** 2).sum(axis=1))
                    order = np.lexsort((ids[starts[near]], d))
                    found: dict[int, float] = {}
                    for dist, j in sorted((float(d[o]), j) for o in order[:reach] for j in ids[starts[near[o]] : starts[near[o] + 1]][:reach].tolist() if j != qid):
                        found.setdefault(j, dist)
                    for j in list(found)[:k]:
                        for o, y in zip(out, (qid, j, found[j]), strict=True):
                            o.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best: Column = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
