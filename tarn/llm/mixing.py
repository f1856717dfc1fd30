"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled (order of the md5 of their id) and their words, end to end, are
cut into blocks of equal size. A slot sequence runs through the golden-ratio points, each of which the
cumulative weights map to a source; the r-th slot of a source takes its block r modulo its number of
blocks, so a prefix of the schedule of any length is mixed in the target proportions. All of it is
DataFrame code; the only table that one task sees whole is the one with a row for each source.

Defined cases: a null text has size 0; a null source is a source of its own, last; documents without
words are taken 0 times; a text of any length is cut over as many blocks as it fills; an empty table gives an empty
result; repeated rows are separate documents; columns but doc_id, source and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

GOLDEN = 0.6180339887498949
#: Slots whose ranks are counted together; sources small beside this still spread over all chunks.
CHUNK = 8192
#: Cells of the unit interval that bring slots and source intervals together.
CELLS = 4096
#: Blocks that the whole corpus makes, roughly, and at least so many in each source.
BLOCKS, LEAST_BLOCKS = 1 << 18, 64
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """source, source_size -> + src (number by code point, null last), weight, target.

    Water-filling in closed form: with sources ordered by cap / weight, the first level that the next
    source's ratio is not below is the common level; each target is the lesser of cap and level * weight.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    ws = F.array(*map(F.lit, weights))
    t = sources.withColumn("src", F.row_number().over(rank)).withColumn(
        "weight", F.element_at(ws, (F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    )
    everything = Window.partitionBy(F.lit(0))
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("cap", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn(
        "level",
        (F.sum("source_size").over(everything) * share - (F.sum("cap").over(by_ratio) - F.col("cap")))
        / (F.sum("weight").over(everything) - (F.sum("weight").over(by_ratio) - F.col("weight"))),
    )
    t = t.withColumn("common", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything))
    return t.select("source", "source_size", "src", "weight", F.least("cap", F.col("common.level") * F.col("weight")).alias("target"))


def blocked(plan: DataFrame, cap: int = 2) -> DataFrame:
    """targets() -> + blocks (of each source), lo and hi (its part of the unit interval), slots (of all)."""
    everything = Window.partitionBy(F.lit(0))
    upto = Window.partitionBy(F.lit(0)).orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("source_size")
    p = plan.where(size > 0).withColumn("block", F.greatest(F.lit(1), F.least(F.lit(65536), F.floor(F.sum(size).over(everything) / BLOCKS), F.floor(size / LEAST_BLOCKS))))
    p = p.withColumn("blocks", F.ceil(size / F.col("block"))).withColumn("share", F.col("target") * F.col("blocks") / size)
    # The last of the running sums, whose order is fixed: a sum in any order could differ in its last bit, and so a rerun.
    p = p.withColumn("sofar", F.sum("share").over(upto))
    p = p.withColumn("all", F.max("sofar").over(everything)).withColumn("hi", F.col("sofar") / F.col("all"))
    p = p.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("src")), F.lit(0.0)))
    return p.select("source", "source_size", "src", "target", "blocks", "lo", "hi", F.ceil("all").alias("slots"))


def schedule(plan: DataFrame, cap: int = 2) -> DataFrame:
    """blocked() -> the mix: slot, src, rank (of the slot in its source), block (taken from the source).

    Slots past cap rounds of a source, which rounding can bring, are left out.
    """
    spark = plan.sparkSession
    n = plan.agg(F.coalesce(F.max("slots"), F.lit(0))).first()[0]
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    slots = spark.range(n).select(F.col("id").alias("slot"), point.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS))
    spans = plan.select("src", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.greatest(last, F.floor(F.col("lo") * CELLS)))).alias("cell"))
    hit = slots.join(spans, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    hit = hit.select("slot", "src", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hit.groupBy("src", "chunk").count().select("src", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("src", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("within", within).join(counts, ["src", "chunk"]).withColumn("rank", F.col("base") + F.col("within"))
    return ranked.where(F.col("rank") < cap * F.col("blocks")).select("slot", "src", "rank", F.pmod("rank", "blocks").alias("block"))


def pieces(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size) -> doc_id, src, off, size, block, words: each document's words in each block.

    The offset of a document in its source's shuffled words is a prefix sum in two levels: over the 4,096
    ranges of the order key, then inside one, so that a source with any share of the rows is spread.
    """
    key = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    d = docs.where("size > 0").join(plan.select("source", "source_size", "src", "blocks").withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    d = d.select("doc_id", "src", "size", "source_size", "blocks", key.alias("key")).withColumn("range", F.substring("key", 1, 3))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy("src", "range").agg(F.sum("size").alias("n")).select("src", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    upto = Window.partitionBy("src", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("end", F.sum("size").over(upto)).join(starts, ["src", "range"])
    d = d.withColumn("off", F.col("start") + F.col("end") - F.col("size")).withColumn("end", F.col("off") + F.col("size"))
    total, n = F.col("source_size"), F.col("blocks")
    block_of = lambda p: F.floor((p * n).cast("decimal(38,0)") / total)
    at = F.explode(F.sequence(block_of(F.col("off")).cast("long"), block_of(F.col("end") - 1).cast("long"))).alias("block")
    d = d.select("doc_id", "src", "off", "end", "size", "source_size", "blocks", at)
    edge = lambda j: F.ceil((j * total).cast("decimal(38,0)") / n).cast("long")
    words = F.least(F.col("end"), edge(F.col("block") + 1)) - F.greatest(F.col("off"), edge(F.col("block")))
    return d.select("doc_id", "src", "off", "size", "block", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, size: Column | None = None) -> DataFrame:
    """documents -> a row each: doc_id, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    n = word_count(F.col("text")) if size is None else size
    sized = written(docs.select("doc_id", "source", n.alias("size")), "mix-sizes")
    plan = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "mix-plan")
    cut = written(blocked(plan, cap), "mix-blocks")
    times = schedule(cut, cap).groupBy("src", "block").agg(F.count("*").alias("times"))
    taken = pieces(sized, cut).join(times, ["src", "block"], "left")
    taken = taken.groupBy("src", "off", "doc_id", "size").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = sized.where("size = 0").join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    out = taken.join(plan, "src").select("doc_id", "source", "size", "source_size", "target", "taken")
    return out.unionByName(empty.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))
