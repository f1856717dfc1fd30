"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

A text's five-word shingles (words lower-cased, split at ASCII white space; fewer words make one
shingle) are hashed once. The top bits of a hash are its bin, and a bin keeps its least hash. An empty
bin takes the value of the first non-empty one in a pseudo-random order of its own: PROBES hashed
positions, then the non-empty bin with the least hash of (this, that), so the choice is the same for
all texts with the same non-empty bins. BITS low-order bits of each bin are stored; the likeness of two
fingerprints is the share of equal bins, corrected for the 2 ** -BITS that agree by chance.

All of it is built-in expressions on one row. Defined cases: a null text is empty; an empty text has no
bins and the fingerprint "", like itself (1) and unlike any other (0); texts of any length are read whole; equal
texts have equal fingerprints; likeness is never below 0; repeated rows are documents each, and their own successors;
an empty table gives an empty result; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS, SHINGLE, PROBES = 256, 8, 5, 6
SPACE = " \t\n\x0b\f\r"
LOG, HALF = BINS.bit_length() - 1, 1 << BITS - 1


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df + out: an array of BINS bytes (empty for an empty text)."""
    p = f"__{out}_"
    w, h, s, m, at, slots = (F.col(p + x) for x in ("words", "hashes", "sorted", "least", "bins", "slots"))
    n = F.size(w)
    df = df.withColumn(p + "words", F.split(F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE)), r"[\x20\x09-\x0D]+"))
    df = df.withColumn(p + "hashes", F.transform(w, lambda x: F.xxhash64(x)))
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(SHINGLE))))
    whole = F.when((n == 1) & (F.get(w, F.lit(0)) == ""), F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
    df = df.withColumn(p + "sorted", F.sort_array(F.when(n >= SHINGLE, each).otherwise(whole))).drop(p + "words", p + "hashes")
    bin_of = lambda x: F.shiftright(x, 64 - LOG) + BINS // 2
    df = df.withColumn(p + "least", F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 64 - LOG) != F.shiftright(F.get(s, i - 1), 64 - LOG)))).drop(p + "sorted")
    df = df.withColumn(p + "bins", F.transform(m, lambda x: bin_of(x).cast("int"))).withColumn(p + "least", F.transform(m, lambda x: (x.bitwiseAND(F.lit((1 << BITS) - 1)) - HALF).cast("tinyint")))
    # All bins in a row, with nulls for the empty ones: each non-empty one behind as many as lie between it and the last.
    nothing = lambda n: F.array_repeat(F.lit(None).cast("tinyint"), n)
    gap = lambda b, i: F.concat(nothing(b - 1 - F.coalesce(F.get(at, i - 1), F.lit(-1))), F.array(F.get(m, i)))
    df = df.withColumn(p + "slots", F.concat(F.flatten(F.transform(at, gap)), nothing(BINS - 1 - F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1)))))
    probe = lambda b, j: F.pmod(F.xxhash64(b, F.lit(j)), F.lit(BINS))
    nearest = lambda b: F.array_min(F.transform(at, lambda c: F.struct(F.xxhash64(b, c, F.lit(-1)).alias("h"), c.alias("c"))))["c"]
    held = lambda b: F.get(slots, b.cast("int"))
    full = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(held(b), *(held(probe(b, j)) for j in range(PROBES)), held(nearest(b))))
    df = df.withColumn(out, F.when(F.size(m).isin(0, BINS), m).otherwise(full))
    return df.drop(p + "least", p + "bins", p + "slots")


def packed(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("int") + HALF), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / BINS
    chance = 2.0**-BITS
    some = F.greatest(F.lit(0.0), (equal - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(some)


def bounds(docs: DataFrame, n: int) -> list:
    """At most n ids of documents, the least among them, that cut the ids in ranges of about equal numbers of rows."""
    shares = [i / n for i in range(n)]
    row = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", shares, 10000).alias("cuts")).first()
    return [] if row["low"] is None else sorted({row["low"], *row["cuts"]})


def range_of(x: Column, cuts: list) -> Column:
    """How many of the cuts are at most x; found in two steps of about the square root of their number."""
    step = max(1, math.isqrt(len(cuts)))
    coarse, fine = F.array(*map(F.lit, cuts[::step])), F.array(*(F.array(*map(F.lit, cuts[i : i + step])) for i in range(0, len(cuts), step)))
    block = F.size(F.filter(coarse, lambda c: c <= x))
    return (block - 1) * step + F.size(F.filter(F.element_at(fine, F.greatest(block, F.lit(1))), lambda c: c <= x))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs + next_<column>: those of the next row in ascending doc_id, of the first row after the last.

    Ids are cut into ranges at ids that occur; the row that begins a range is also sent, marked, to the
    end of the range before (the least one to that of the last), so that one exchange by range gives
    every row its successor, whatever the number of rows. Null ids come last; ties by the first column. Rows
    that share an id stay in one range, as their order among themselves asks.
    """
    n = min(4096, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = bounds(docs, n)
    last = max(1, len(cuts))
    at = F.coalesce(range_of(F.col("doc_id"), cuts), F.lit(last)) if cuts else F.lit(1)
    copy = F.when(F.col("doc_id").isin(cuts) if len(cuts) <= 16 else F.array_contains(F.array(*map(F.lit, cuts)), F.col("doc_id")), F.when(at == 1, last).otherwise(at - 1))
    ways = F.filter(F.array(F.struct(at.alias("range"), F.lit(False).alias("mark")), F.struct(copy.alias("range"), F.lit(True).alias("mark"))), lambda s: s["range"].isNotNull())
    df = docs.withColumn("__way", F.explode(ways)).withColumns({"__range": F.col("__way.range"), "__mark": F.col("__way.mark")}).drop("__way")
    order = Window.partitionBy("__range").orderBy("__mark", F.col("doc_id").asc_nulls_last(), columns[0])
    df = df.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return df.where(~F.col("__mark")).drop("__range", "__mark")


def edit_check(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_next(with_fingerprint(df, "text", "own"), ["text", "own"])
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    following = F.coalesce("next_text", F.lit(""))
    df = df.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(following, F.lit(1), half))).drop("text", "next_text")
    df = with_fingerprint(df, "edited", "other")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("own")).alias("fingerprint"),
        packed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next_own", F.array().cast("array<tinyint>"))).alias("near_next"),
    )
