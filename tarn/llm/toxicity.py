"""Toxicity: a logistic classifier on word features, regularised by counterfactual swaps of identity terms.

Training: a bounded, stratified sample of labelled documents (TRAIN_EACH of each label, those of least
hash of their id) gives sets of word features; the FEATURES with the largest significance of their log
odds are kept. The loss is the logistic one, plus an L2 term, plus LAMBDA times the mean squared change
of the logit when a sentence's identity terms are swapped for others of their group (every sentence of the
sample that holds such terms, however long, and frames of neutral mentions), which takes weight away from
the terms themselves. A swap changes features of identity terms only, so the mean square is a quadratic
form in their weights: executors sum its coefficients, and no sentence reaches the driver. Both labels
count alike in the loss; the intercept then follows the share of label 1 among the labels learnt from.

Features of a word (ASCII letters lower-cased, cut at anything but letters, digits and other
non-ASCII characters): the word itself and its prefixes of 4 to 8 characters, so that inflected and compound forms
count. A document is the set of its features; every text is read whole, in training and in scoring.

Defined cases: null and empty texts have no features and score the intercept; a text of any length is one set of
words; texts without a label or with a null one are only scored; labels of unknown documents count only for the
share of label 1, those of null ids for nothing; of repeated labels for a document the larger one counts; with
labels of one kind only, or none, all scores are the smoothed share of label 1; repeated rows are scored each; an
empty table gives an empty result; other columns pass through, but one named like the result is replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, forget, texts_of, tidy, written

#: Labelled documents of each label in the training sample; features at most (a bound on memory: on sf0.1 fewer than 1,024
#: are significant); prefix lengths.
TRAIN_EACH, FEATURES, PREFIXES = 4000, 1 << 16, range(4, 9)
LAMBDA, L2, LEAST_DOCS, LEAST_Z, STEPS = 4.0, 1e-5, 5, 3.0, 3000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Groups of identity terms; a swap stays inside a group. Fixed values.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("she", "he", "they"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "transgender", "heterosexual"),
    ("immigrant", "citizen", "refugee", "foreigner", "native"),
    ("immigrants", "citizens", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf", "autistic"),
    ("german", "french", "spanish", "english", "american", "chinese", "russian", "indian", "mexican", "turkish", "polish"),
)
#: Neutral mentions, which no term of a group should make toxic. Fixed values.
FRAMES = ("{} people live here", "i am {}", "my neighbour is {}", "the {} family went to the market", "we met some {} friends")

#: Term -> its group, from itself on; what ends a sentence.
TERMS = {t.encode(): [x.encode() for x in g[i:] + g[:i]] for g in IDENTITIES for i, t in enumerate(g)}
STOPS = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[bytes]:
    return set(WORD.findall(text.encode().lower())) if text else set()


def word_features(word: bytes) -> list[str]:
    w = word.decode()
    return [w, *(f"{w[:n]}*" for n in PREFIXES if n <= len(w))]


def features(words: set[bytes]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def distinct_words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, toxic, text) -> doc_id, toxic, words (its distinct ones), sentences (the words of each that names an identity)."""
    kept = docs.select("doc_id", "toxic", "text")
    _, schema = extended(kept.drop("text"), words="array<string>", sentences="array<array<string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        plain = lambda ws: sorted(w.decode() for w in ws)
        for b in batches:
            words, said = [], []
            for t in texts_of(b.column(2)):
                own = words_of(t)
                words.append(plain(own))
                said.append([plain(x) for s in STOPS.split(t) if (x := words_of(s)) & TERMS.keys()] if own & TERMS.keys() else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string())), pa.array(said, pa.list_(pa.list_(pa.string())))], schema.names)

    return kept.mapInArrow(run, schema)


def swapped(words: set[bytes]) -> set[bytes]:
    """The words with each identity term replaced by another of its group, chosen by a hash of the whole set."""
    h = zlib.crc32(b" ".join(sorted(words)))
    return {w if w not in TERMS else TERMS[w][1 + (h + zlib.crc32(w)) % (len(TERMS[w]) - 1)] for w in words}


def change(one: set[bytes], other: set[bytes], at: dict[str, int]) -> list[tuple[int, int]]:
    """Numbers of the features that only one of two sets of words has: +1 for the first's, -1 for the second's."""
    a, b = features(one - other), features(other - one)
    both = features(one & other) if a | b else set()
    return [(at[f], sign) for own, theirs, sign in ((a, b, 1), (b, a, -1)) for f in sorted(own - theirs - both) if f in at]


def products(changes: list[list[tuple[int, int]]], into: Counter) -> None:
    """Adds each change's product with itself, entry by entry, and their number under (-1, -1)."""
    for c in changes:
        into[-1, -1] += 1
        for i, x in c:
            for j, y in c:
                into[i, j] += x * y


def frame_products(at: dict[str, int]) -> Counter:
    out: Counter = Counter()
    for g in IDENTITIES:
        for f in FRAMES:
            products([change(words_of(f.format(a)), words_of(f.format(b)), at) for a, b in zip(g, g[1:] + g[:1], strict=True)], out)
    return out


def swap_products(words: DataFrame, kept: list[str]) -> Counter:
    """distinct_words() -> the summed products() of all its sentences: whole numbers, of identity terms' features only,
    so at most a few hundred squared, however many sentences there are."""
    held = words.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(held.value)}
        total: Counter = Counter()
        for b in batches:
            for said in texts_of(b.column(0)):
                own = [{w.encode() for w in x} for x in said]
                products([change(x, swapped(x), at) for x in own], total)
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.int32()) for i in (0, 1)] + [pa.array(total.values(), pa.int64())], ["i", "j", "n"])

    rows = words.select("sentences").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    return Counter({(r["i"], r["j"]): r["n"] for r in rows})


class Model:
    """weights: feature -> weight; a document's logit is the intercept and the sum over its set of features."""

    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept
        self.known: dict[bytes, tuple[str, ...]] = {}

    def hits(self, words: set[bytes]) -> set[str]:
        known, out = self.known, set()
        for w in words:
            f = known.get(w)
            if f is None:
                if len(known) > 200_000:
                    known.clear()
                f = known[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                out.update(f)
        return out

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[f] for f in sorted(self.hits(words_of(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def counted(words: DataFrame) -> DataFrame:
    """distinct_words() -> feature, one, zero: how many documents of each label have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for label, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.update((f, label) for f in features({w.encode() for w in own}))
                if len(held) > 200_000:
                    yield flush(held)
        if held:
            yield flush(held)

    def flush(held: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([n * t for (_, t), n in held.items()], pa.int64()), pa.array([n * (1 - t) for (_, t), n in held.items()], pa.int64())], ["feature", "one", "zero"])
        held.clear()
        return out

    rows = words.select(F.col("toxic").cast("int").alias("toxic"), "words").mapInArrow(run, "feature string, one long, zero long")
    return rows.groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))


def significant(counts: DataFrame, pos: int, neg: int) -> list[str]:
    """The FEATURES features of largest significance of their log odds, where that is LEAST_Z at least."""
    a, b = F.col("one") + 0.5, F.col("zero") + 0.5
    z = (F.log(a / (pos - F.col("one") + 0.5)) - F.log(b / (neg - F.col("zero") + 0.5))) / F.sqrt(1 / a + 1 / b)
    kept = counts.where(F.col("one") + F.col("zero") >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z)
    return [r["feature"] for r in kept.orderBy(F.col("z").desc(), "feature").limit(FEATURES).collect()]


def hits(words: DataFrame, kept: list[str]) -> list[tuple[list[int], int]]:
    """distinct_words() -> (numbers in kept of the features that it has, label) of each document, by doc_id."""
    held = words.sparkSession.sparkContext.broadcast(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {f: i for i, f in enumerate(held.value)}
        for b in batches:
            found = [sorted(at[f] for f in features({w.encode() for w in own}) if f in at) for own in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "toxic", "found"])

    kind = words.schema["doc_id"].dataType.simpleString()
    rows = words.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "words").mapInArrow(run, f"doc_id {kind}, toxic int, found array<int>")
    return [(r["found"], r["toxic"]) for r in rows.orderBy("doc_id").collect()]


def fit(kept: list[str], rows: list[tuple[list[int], int]], swaps: Counter, share: float, steps: int = STEPS) -> Model:
    """rows: (numbers in kept, label), of both labels; swaps: products(). Accelerated gradient descent on the regularised
    loss; share: of label 1, which the intercept follows."""
    y = np.array([t for _, t in rows], float)
    pos, neg = y.sum(), (1 - y).sum()
    n = len(kept)
    r = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    c = np.array([i for f, _ in rows for i in f], np.int64)
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)  # both labels count alike here; the intercept is set afterwards
    m = max(1, swaps[-1, -1])
    named = sorted({i for i, _ in swaps if i >= 0})
    place = {i: k for k, i in enumerate(named)}
    form = np.zeros((len(named), len(named)))
    for (i, j), x in swaps.items():
        if i >= 0:
            form[place[i], place[j]] = x / m
    w, b, vw, vb = np.zeros(n), 0.0, np.zeros(n), 0.0
    # A bound on the curvature, for the step: the largest column sum of X'WX, and that of the swaps' part.
    docs_part = np.bincount(c, (weight * (1 + np.bincount(r, minlength=len(y))))[r], n).max(initial=1)
    step = 1.0 / (0.25 * (docs_part + 1) + L2 + 2 * LAMBDA * np.abs(form).sum(axis=0).max(initial=0))
    for i in range(steps):
        lw, lb = w + i / (i + 3) * (w - vw), b + i / (i + 3) * (b - vb)
        vw, vb = w, b
        z = np.bincount(r, lw[c], len(y)) + lb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        gw = np.bincount(c, g[r], n) + L2 * lw
        gw[named] += 2 * LAMBDA * (form @ lw[named])
        w, b = lw - step * gw, lb - step * g.sum()
    return Model({f: float(w[i]) for i, f in enumerate(kept) if w[i]}, float(b + np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, each: int = TRAIN_EACH) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic); learn: a condition on doc_id that its labels may be learnt from.

    Of the sample (at most 2 * each documents) only the counts of the best features, which of them each
    document has, and the sums of products over its sentences reach the driver.
    """
    docs, labels = docs.select("doc_id", "text"), labels.select("doc_id", "toxic")
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {t: n for t, n in known.groupBy("toxic").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    # Those of least hash: first a range of hashes that about twice as many share, so that few rows are sorted.
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    some = [known.where((F.col("toxic") == t) & (key < int((1 << 40) * min(1, (2 * each + 200) / counts.get(t, 1))))).orderBy(key, "doc_id").limit(each) for t in (0, 1)]
    chosen = some[0].unionByName(some[1])
    # Of repeated documents one is learnt from, the one of fewest and least words.
    sample = docs.join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.size("words").alias("n"), F.array_sort("words").alias("words"), F.array_sort("sentences").alias("sentences"))).alias("x")
    words = written(distinct_words(sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one).select("doc_id", "toxic", "x.words", "x.sentences"), "toxicity-sample")
    found = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return Model({}, float(np.log(share / (1 - share))))
    kept = significant(counted(words), found[1], found[0])
    swaps = frame_products({f: i for i, f in enumerate(kept)})
    swaps.update(swap_products(words, kept))
    return fit(kept, hits(words, kept), swaps, share)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs -> their columns and the score (0 to 1). The model, of bounded size, is sent with the tasks."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    docs, schema = extended(docs, **{out: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        m = Model(*held.value)
        for b in batches:
            scores = [m.score(t) for t in texts_of(b.column(b.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], schema.names)
        m.known.clear()
        tidy()

    return docs.mapInArrow(run, schema)
