"""LM scoring: a log-bilinear neural model, trained by noise-contrastive estimation, over corpus counts.

Tokens are words (lower-cased in A-Z, split at ASCII white space) and one end for each text. Counts of all
tokens of all training texts are a table, however large. The OWN most frequent words and the end are classes
of the neural model by themselves; every other word, seen or not, belongs to one of BUCKETS classes by its
last bytes. Inside such a class, each of the next OUT most frequent words (those that occur LEAST times; their
number grows with the corpus up to that bound) has an output vector of its own, and one slot stands for all
others. From the last CONTEXT classes the model gives a normalised distribution in two factors:

    q = sum_i weight_i * vector(class_i)
    P(class | context)       = softmax over classes of  q . output(class) + bias(class)
    P(slot | class, context) = softmax over its slots of q . row(slot) + bias(slot)

and a word in the slot of all others has its share of their counts, one added to each and one more for all
unseen words together; so the probabilities of all words add up to 1 in every context.

Training covers every training text once, in ROUNDS parts. In a round each task runs stochastic steps over its own
texts from the common model; then the parameters are averaged on executors, those of classes weighted by tokens, a
slot's by how often the task met it, and the next round starts from the mean. Noise comes from the class
frequencies (NOISE samples for a step's positions) and inside classes from the counts (SLOT_NOISE for each position).
The model's size is bounded. Scoring multiplies batches of context vectors by all class outputs at once, and those of a
class's positions by all its slots.

Counts of the HEAD most frequent words, a bounded table, go to all workers; the other words of a text are
joined to the counts by word, and only they are exchanged.

Defined cases: a null or blank text is its end alone; texts of any length are read whole; a null id counts as a
training text; repeated rows count and are scored each; with no training text every word is unseen and classes are
equally likely; an empty table gives an empty result; columns but doc_id and text are ignored. The score depends in
its last digits on how the input is partitioned, as steps do; reruns over the same partitions agree.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, written

#: Words that are classes; classes of the others; words with counts in all workers; words with rows, which occur so often.
OWN, BUCKETS, HEAD, OUT, LEAST = 63, 128, 1 << 17, 1 << 15, 5
CLASSES, END = OWN + 1 + BUCKETS, OWN
DIM, CONTEXT, NOISE, TIMES, RATE = 16, 6, 64, 8.0, 0.15
#: A step's positions: so many pieces of so many in a row. Samples for each position inside its class; see Trainer.
PIECES, PIECE, SLOT_NOISE, GUIDE = 32, 32, 4, 8
#: Scores that are held at once: 192 KB.
CELLS = 49_152
#: Parts of the training texts, after each of which models are averaged.
ROUNDS = 2
#: Bytes of a head word, so that the head has a size in bytes as well.
HEAD_BYTES = 256
#: A-Z to lower case, and every kind of ASCII white space to a blank.
PLAIN = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of texts that are cut into words, learnt from or scored at a time (at least one text).
AT_ONCE = 1 << 22
#: The same where words are only counted.
COUNTED = 32 << 20


def packs(texts: pa.Array, size: int = 0) -> Iterator[pa.Array]:
    """A column of binaries in parts of about size bytes (AT_ONCE)."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + (size or AT_ONCE), side="right")) - 1)
        yield texts.slice(at, upto - at)
        at = upto


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A column of binaries, none null -> the words of all texts in a row, and how many each has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    plain = np.frombuffer(raw.slice(ends[0], ends[-1] - ends[0]).to_pybytes().translate(PLAIN) if raw else b"", np.uint8)
    ends = ends - ends[0]
    inside = plain != 32
    first = np.ones(len(plain), bool)
    first[1:] = ~inside[:-1]
    first[ends[:-1][ends[:-1] < len(plain)]] = True
    starts = np.flatnonzero(first & inside)
    before = np.cumsum(inside, dtype=np.int32)
    kept = plain[inside]
    offsets = np.append(before[starts] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes())])
    return words, np.diff(np.searchsorted(starts, ends))


def bucket_class(word: bytes) -> int:
    return OWN + 1 + zlib.crc32(word[-3:]) % BUCKETS


def word_counts(texts: DataFrame) -> DataFrame:
    """texts (text as binary) -> word (binary), c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in packs(b.column(0), COUNTED):
                found = words_of(part)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "c"])
        tidy()

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """own: words of classes 0 to OWN - 1; logs: head word -> log10(c + 1); out: the words with rows, by class, then order
    of frequency; first: the place of each bucket's slot of all others (the last: the number of slots), its words' follow;
    shares: of classes; inside: counts of slots; others: log10 of the counts of each bucket's slot of all others."""

    def __init__(self, own: list[bytes], logs: dict[bytes, float], out: list[bytes], first: np.ndarray, shares: np.ndarray, inside: np.ndarray) -> None:
        self.own, self.logs, self.out, self.first, self.shares, self.inside = own, logs, out, first, shares, inside

    @cached_property
    def cls(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.own)}

    @cached_property
    def slot(self) -> dict[bytes, int]:
        slots = np.setdiff1d(np.arange(self.first[-1]), self.first[:-1])
        return dict(zip(self.out, slots.tolist(), strict=True))

    def plain(self) -> tuple:
        """What a broadcast can carry to workers that lack this module: numbers, and words as known() has them, so that no
        task looks them all up again."""
        return self.first, self.shares, self.inside, vars(self.known())

    @classmethod
    def carried(cls, first: np.ndarray, shares: np.ndarray, inside: np.ndarray, known: dict) -> tuple[Vocabulary, Words]:
        """Of plain(): a vocabulary of numbers alone, and known()."""
        words = Words.__new__(Words)
        vars(words).update(known)
        return cls([], {}, [], first, shares, inside), words

    def known(self) -> Words:
        return Words(self)

    def bucket_of_slots(self) -> np.ndarray:
        return np.repeat(np.arange(BUCKETS), np.diff(self.first))

    def inner_logs(self) -> np.ndarray:
        """Natural log of each slot's share of its class by counts."""
        of = self.bucket_of_slots()
        return np.log(self.inside / np.bincount(of, self.inside, BUCKETS)[of])

    def other_logs(self) -> np.ndarray:
        """For each class, log10 of what a count in its slot of all others is divided by; 0 for words and the end."""
        return np.concatenate([np.zeros(OWN + 1), np.log10(self.inside[self.first[:-1]])])


#: The table of crc32, from its value for each single byte.
TABLE = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFFFFFFFF ^ 0x00FFFFFF for i in range(256)], np.uint32)


class Words:
    """What words are, by column: cls; slot (-1 if the class is a word); base (log10 of its count + 1; NaN outside the head);
    log (the same, but 0 for words of a class or slot of their own)."""

    def __init__(self, v: Vocabulary) -> None:
        head = list(v.logs)
        self.head = pa.array(head, pa.binary())
        self.first = v.first
        self.base = np.append(np.fromiter(v.logs.values(), np.float64, len(head)), math.nan)
        own = np.fromiter((v.cls.get(w, -1) for w in head), np.int32, len(head))
        slot = np.fromiter((v.slot.get(w, -1) for w in head), np.int32, len(head))
        bucket = bucket_classes(self.head)
        self.cls = np.where(own >= 0, own, bucket).astype(np.int32)
        self.slot = np.where(own >= 0, -1, np.where(slot >= 0, slot, self.first[bucket - OWN - 1])).astype(np.int32)
        self.log = np.append(np.where((own >= 0) | (slot >= 0), 0.0, self.base[:-1]), math.nan)

    def columns(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """cls, slot, log and base of each word; every distinct one is looked up once."""
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.head).fill_null(-1).to_numpy()
        cls = bucket_classes(coded.dictionary)
        slot = self.first[cls - OWN - 1].astype(np.int32)
        some = at >= 0
        cls[some], slot[some] = self.cls[at[some]], self.slot[at[some]]
        every = coded.indices.to_numpy().astype(np.intp)
        return cls.take(every), slot.take(every), self.log[at].take(every), self.base[at].take(every)


def bucket_classes(words: pa.Array) -> np.ndarray:
    """bucket_class() of each word, none of which is empty: crc32 of the last three bytes, a byte at a time."""
    if not len(words):
        return np.array([], np.int32)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        at = ends[1:] - back
        ok = at >= ends[:-1]
        crc[ok] = TABLE[(crc[ok] ^ raw[at[ok]]) & 0xFF] ^ crc[ok] >> np.uint32(8)
    return (OWN + 1 + (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int32)


PAD = [END] * CONTEXT


def stream(words_cls: np.ndarray, words_slot: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes and slots of the words of texts of these lengths -> the same with CONTEXT ends before each text and its own end
    after it, and the places that are scored: the words and that end."""
    lengths = lengths + 1
    total = int((lengths + CONTEXT).sum())
    at = np.ones(total, bool)
    heads = np.cumsum(lengths + CONTEXT) - lengths - CONTEXT
    at[(heads[:, None] + np.arange(CONTEXT)).ravel()] = False
    places = np.flatnonzero(at)
    cls, slot = np.full(total, END, np.int32), np.full(total, -1, np.int32)
    ends = np.cumsum(lengths) - 1
    inner = np.delete(places, ends)
    cls[inner], slot[inner] = words_cls, words_slot
    return cls, slot, places


class Model:
    """parts: vectors (CLASSES, DIM), weights (CONTEXT, DIM), outputs (CLASSES, DIM), bias (CLASSES, 1); rows: (slots, DIM + 1),
    a slot's output and its bias."""

    SHAPES = ((CLASSES, DIM), (CONTEXT, DIM), (CLASSES, DIM), (CLASSES, 1))

    def __init__(self, parts: list[np.ndarray], rows: np.ndarray, first: np.ndarray) -> None:
        self.parts, self.rows, self.first = parts, rows, first

    @classmethod
    def start(cls, v: Vocabulary) -> Model:
        rng = np.random.default_rng(11)
        near = [rng.normal(0, 0.3, s) for s in cls.SHAPES[:3:2]]
        parts = [near[0], np.full(cls.SHAPES[1], 1 / CONTEXT), near[1] * 0.3, np.log(v.shares)[:, None]]
        return cls([x.astype(np.float32) for x in parts], np.concatenate([np.zeros((v.first[-1], DIM)), v.inner_logs()[:, None]], axis=1).astype(np.float32), v.first)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    @classmethod
    def of(cls, flat: np.ndarray, rows: np.ndarray, first: np.ndarray) -> Model:
        return cls(cls.views(np.array(flat, np.float32)), rows, first)

    @classmethod
    def views(cls, flat: np.ndarray) -> list[np.ndarray]:
        """The parts as views of flat."""
        cuts = np.cumsum([math.prod(s) for s in cls.SHAPES])[:-1]
        return [x.reshape(s) for x, s in zip(np.split(flat, cuts), cls.SHAPES, strict=True)]

    def context(self, near: np.ndarray) -> np.ndarray:
        """near (..., CONTEXT + n, DIM), vectors of the classes in a row -> context vectors of the last n."""
        n = near.shape[-2] - CONTEXT
        # A PIECE of vectors is one row where they fill such rows, and weights are repeated along it.
        long = PIECE if n % PIECE == 0 else 1
        near, along = near.reshape(*near.shape[:-2], -1), np.tile(self.parts[1], long)
        ago = lambda i: near[..., (CONTEXT - 1 - i) * DIM : (CONTEXT - 1 - i + n) * DIM].reshape(*near.shape[:-1], -1, long * DIM)
        out = ago(0) * along[0]
        part = np.empty_like(out)
        for i in range(1, CONTEXT):
            out += np.multiply(ago(i), along[i], out=part)
        return out.reshape(*near.shape[:-1], n, DIM)

    def log_probs(self, cls: np.ndarray, slot: np.ndarray, places: np.ndarray, size: int = 1 << 14, block: int = 1 << 16) -> np.ndarray:
        """A stream() -> natural logs of P(class, slot | context) at its places, normalised over all classes and slots."""
        vectors, _, outputs, bias = self.parts
        cls = np.concatenate([PAD, cls, [END] * (-len(cls) % PIECE)]).astype(np.int32)
        wide = np.ascontiguousarray(np.concatenate([outputs, bias], axis=1).T)
        out = np.empty(len(places))
        cuts = np.searchsorted(places, np.arange(0, len(slot) + block, block))
        for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            start, at = n * block, places[a:b]
            q = np.ones((b - a, DIM + 1), np.float32)
            q[:, :DIM] = self.context(vectors.take(cls[start : start + block + CONTEXT], axis=0))[at - start]
            with np.errstate(over="ignore", under="ignore"):
                out[a:b] = self.block_log_probs(q, cls[at + CONTEXT], slot[at], wide, size)
        return out

    def block_log_probs(self, q: np.ndarray, cls: np.ndarray, slot: np.ndarray, wide: np.ndarray, size: int) -> np.ndarray:
        out = np.empty(len(cls))
        for s in range(0, len(cls), size):
            out[s : s + size] = log_softmax(q[s : s + size], wide, cls[s : s + size])
        by = np.argsort(cls.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(cls[by], np.arange(OWN + 1, CLASSES + 1))
        for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            rows = np.ascontiguousarray(self.rows[self.first[g] : self.first[g + 1]].T)
            for s in range(a, b if rows.shape[1] > 1 else a, size):
                at = by[s : min(b, s + size)]
                out[at] += log_softmax(q.take(at, axis=0), rows, slot[at] - self.first[g])
        return out


def log_softmax(q: np.ndarray, wide: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The own columns of the log of the softmax of the rows of q @ wide.

    Exponentials are taken as they are; where their sum leaves single precision, again less the row's largest score. Scores
    are made a few rows at a time in the same CELLS numbers, which stay in a core's cache.
    """
    n, width = len(q), wide.shape[1]
    rows = max(16, CELLS // width)
    cells, ones = np.empty((min(n, rows), width), np.float32), np.ones(width, np.float32)
    at, total = np.empty(n), np.empty(n, np.float32)
    for s in range(0, n, rows):
        upto = min(n, s + rows)
        z = np.matmul(q[s:upto], wide, out=cells[: upto - s])
        at[s:upto] = z[np.arange(upto - s), own[s:upto]]
        np.matmul(np.exp(z, out=z), ones, out=total[s:upto])
    if not (total.min() > 1e-25 and total.max() < 1e35):
        far = np.flatnonzero(~((total > 1e-25) & (total < 1e35)))
        z = q[far] @ wide
        top = z.max(axis=1)
        z -= top[:, None]
        at[far] -= top
        total[far] = np.exp(z, out=z).sum(axis=1)
    return at - np.log(total)


def columns_summed(rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Rows of values, which are given by column, summed by row number."""
    out, rows = np.empty((len(columns), n)), rows.astype(np.intp, copy=False)
    for i, c in enumerate(columns):
        out[i] = np.bincount(rows, c, n)
    return out.T


def whole(rows: np.ndarray) -> np.ndarray:
    """A contiguous table's rows as one value each, which are put in place faster."""
    return rows.view(f"V{rows.shape[1] * rows.itemsize}")[:, 0]


class Trainer:
    """Noise-contrastive steps on a model (Adagrad; past and past_rows: sums of squared gradients; met: how often each slot was)."""

    def __init__(self, model: Model, v: Vocabulary, past: list[np.ndarray], past_rows: np.ndarray, seed: int) -> None:
        self.model, self.past_rows = model, past_rows
        self.rng = np.random.default_rng(seed)
        # Parameters of all parts are one array, of which the parts are views, so that a step updates them at once; so are their sums.
        self.flat, self.past_flat = model.flat(), np.concatenate([np.zeros(0), *(h.ravel() for h in past)])
        model.parts, self.past = Model.views(self.flat), Model.views(self.past_flat) if past else []
        self.met, self.seen = np.zeros(len(model.rows), np.float32), []
        self.up_to, self.add = np.cumsum(v.shares), np.log(TIMES * v.shares).astype(np.float32)
        self.inner = v.inner_logs().astype(np.float32)
        self.first, self.sums = v.first, np.concatenate([[0], np.cumsum(v.inside)])
        self.low, self.ends, self.final = self.sums[v.first[:-1]], self.sums[1:], v.first[1:] - 1
        self.span = self.sums[v.first[1:]] - self.low
        # For GUIDE even cells to a slot, the slot in which each begins: where the search for a sample starts.
        self.cells = GUIDE * np.diff(v.first)
        self.cell = np.append(0, np.cumsum(self.cells))[:-1]
        part = (np.arange(self.cells.sum()) - np.repeat(self.cell, self.cells)) / np.repeat(self.cells, self.cells)
        self.guide = self.found(np.repeat(self.low, self.cells) + part * np.repeat(self.span, self.cells), np.repeat(np.arange(BUCKETS), self.cells)).astype(np.min_scalar_type(v.first[-1]))
        # For a step: the weights of a piece's contexts as matrices, and a number for each slot.
        self.band, self.last = np.zeros((DIM, CONTEXT + PIECE, PIECE), np.float32), np.empty(len(model.rows), np.int64)
        self.bands = [self.band.reshape(DIM, -1)[:, (CONTEXT - 1 - i) * PIECE :: PIECE + 1][:, :PIECE] for i in range(CONTEXT)]
        self.diagonals = np.array([(CONTEXT - 1 - i) * PIECE + (PIECE + 1) * np.arange(PIECE) for i in range(CONTEXT)])

    def found(self, at: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The slots of places in the running sums of counts, kept in their buckets."""
        return np.clip(np.searchsorted(self.sums, at, side="right") - 1, self.first[bucket], self.first[bucket + 1] - 1)

    def drawn(self, bucket: np.ndarray) -> np.ndarray:
        """SLOT_NOISE slots of each bucket, by counts."""
        u = self.rng.random((len(bucket), SLOT_NOISE))
        at = u * self.span.take(bucket)[:, None]
        at += self.low.take(bucket)[:, None]
        cell = (u * self.cells.take(bucket)[:, None]).astype(np.int64)
        cell += self.cell.take(bucket)[:, None]
        slot = self.guide.take(cell.ravel()).astype(np.int64)
        at = at.ravel()
        todo = np.flatnonzero(self.ends.take(slot) <= at)
        slot[todo] = np.searchsorted(self.sums, at[todo], side="right") - 1
        return np.minimum(slot.reshape(u.shape), self.final.take(bucket)[:, None])

    def learn(self, cls: np.ndarray, slot: np.ndarray, lengths: np.ndarray) -> int:
        """One pass over texts (see stream()), in steps of PIECES pieces from anywhere in them; returns the number of tokens."""
        np.seterr(over="ignore")  # exp of a large score: the gradient is then 0, as it should be
        cls, slot, places = stream(cls, slot, lengths)
        pieces = -(-len(cls) // PIECE)
        end = pieces * PIECE - len(cls)
        cls, slot = np.concatenate([PAD, cls, [END] * end]).astype(np.int32), np.concatenate([slot, [-1] * end]).astype(np.int32)
        counts = np.zeros(len(slot), bool)
        counts[places] = True
        slot, counts = slot.reshape(pieces, PIECE), counts.reshape(pieces, PIECE)
        order = self.rng.permutation(pieces)
        row = np.arange(CONTEXT + PIECE)
        for s in range(0, pieces, PIECES):
            some = order[s : s + PIECES]
            self.step(cls[some[:, None] * PIECE + row], slot[some], np.flatnonzero(counts[some]))
            if s + PIECES >= pieces or len(self.seen) == 64:
                self.met += np.bincount(np.concatenate(self.seen), minlength=len(self.met))
                self.seen.clear()
        return len(places)

    def step(self, cls: np.ndarray, slot: np.ndarray, at: np.ndarray) -> None:
        """cls (pieces, CONTEXT + PIECE), slot (pieces, PIECE), at: places that count."""
        vectors, weights, outputs, bias = self.model.parts
        pieces, n = len(cls), len(at)
        # By dimension, so that contexts, and their gradients, are products with a matrix of the weights: Model.context() in one.
        near = vectors.T.take(cls, axis=1)
        for band, w in zip(self.bands, weights, strict=True):
            band[:] = w[:, None]
        # Positions in classes of several words come first, so that they are a slice.
        slot = slot.ravel().take(at)
        inner = slot >= 0
        m, at, slot = np.count_nonzero(inner), np.concatenate([at[inner], at[~inner]]), slot[inner]
        qt = np.ones((DIM + 1, n), np.float32)
        np.take((near @ self.band).reshape(DIM, -1), at, axis=1, out=qt[:DIM], mode="clip")
        q = np.ascontiguousarray(qt.T)
        t = cls[:, CONTEXT:].ravel().take(at)
        noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE)), CLASSES - 1)
        # A class that is drawn several times is one column that counts so often.
        times = np.bincount(noise, minlength=CLASSES)
        noise = np.flatnonzero(times)
        wide = np.concatenate([outputs, (bias[:, 0] - self.add)[:, None]], axis=1)
        mine, others = wide.take(t, axis=0), wide.take(noise, axis=0)
        g_own = 1 / (1 + np.exp(np.einsum("ij,ij->i", q, mine))) / n
        z = q @ -others.T
        np.exp(z, out=z)
        z += 1
        g_noise = np.divide((times[noise] * (-TIMES / NOISE / n)).astype(np.float32), z, out=z)
        gq = g_own[:, None] * mine[:, :DIM] + g_noise @ others[:, :DIM]
        go = columns_summed(t, qt * g_own, CLASSES)
        go[noise] += g_noise.T @ q
        gq[:m] += self.inside(t[:m] - OWN - 1, slot, q[:m], qt[:, :m]) / n
        full = np.zeros((pieces * PIECE, DIM), np.float32)
        whole(full)[at] = whole(gq)
        full = np.ascontiguousarray(full.T).reshape(DIM, pieces, PIECE)
        met = (near.transpose(0, 2, 1) @ full).reshape(DIM, -1)
        gw = met.take(self.diagonals, axis=1).sum(axis=2).T
        gv = columns_summed(cls.ravel(), (full @ self.band.transpose(0, 2, 1)).reshape(DIM, -1), CLASSES)
        g = np.concatenate([gv.ravel(), gw.ravel(), go[:, :DIM].ravel(), go[:, DIM]])
        self.past_flat += g * g
        g *= RATE
        g /= np.sqrt(self.past_flat + 1e-10)
        self.flat += g.astype(np.float32)

    def inside(self, bucket: np.ndarray, slot: np.ndarray, q: np.ndarray, qt: np.ndarray) -> np.ndarray:
        """A step on the slots of positions in classes of several words -> the gradient of their context vectors. q: those
        vectors and a 1; qt: the same by column."""
        rows = self.model.rows
        noise = self.drawn(bucket)
        which = np.concatenate([slot[:, None], noise], axis=1)
        taken = rows.take(which, axis=0)
        z = np.einsum("mkd,md->mk", taken, q)
        z -= self.inner[which] + np.float32(math.log(SLOT_NOISE))
        g = -1 / (1 + np.exp(-z))
        g[:, 0] += 1
        gq = np.einsum("mk,mkd->md", g, taken[:, :, :DIM])
        which = which.T.ravel()
        # Each slot is numbered by writing over its last entry's place, without a sort.
        place = np.arange(len(which))
        self.last[which] = place
        hit = which[self.last.take(which) == place]
        self.last[hit] = place[: len(hit)]
        number = self.last.take(which)
        each = np.ascontiguousarray(g.T) * qt[:, None]
        total = columns_summed(number, each.reshape(DIM + 1, -1), len(hit)).astype(np.float32, order="C")
        self.seen.append(which)
        past = self.past_rows.take(hit, axis=0)
        past += total * total
        whole(self.past_rows)[hit] = whole(past)
        np.sqrt(past, out=past)
        total *= np.float32(RATE)
        total /= past
        total += rows.take(hit, axis=0)
        whole(rows)[hit] = whole(total)
        return gq


#: A trained model on its way to the mean: its task and tokens; parts and rows with their sums of squares; met.
CARRIED = "part long, tokens double, parts binary, rows binary, met binary"


def fit(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """texts (text as binary), all of which are learnt from, each in one round -> the averaged model."""
    model = Model.start(vocabulary)
    n_rows, dense = len(model.rows), len(model.flat())
    parts = np.stack([model.flat(), np.full(dense, 1e-6, np.float32)])
    rows = np.stack([model.rows, np.full_like(model.rows, 1e-2)])
    spark, plain = texts.sparkSession, vocabulary.plain()
    for number in range(ROUNDS):
        held = spark.sparkContext.broadcast((plain, parts, rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v, known = Vocabulary.carried(*held.value[0])  # noqa: B023
            parts, rows = (x.copy() for x in held.value[1:])  # noqa: B023
            model = Model.of(parts[0], rows[0], v.first)
            past = Model.of(parts[1], rows[1], v.first)
            trainer = Trainer(model, v, [p.astype(np.float64) for p in past.parts], rows[1], TaskContext.get().partitionId())
            tokens = 0
            for b in batches:
                for pack in packs(b.column(0)):
                    words, lengths = words_of(pack)
                    tokens += trainer.learn(*known.columns(words)[:2], lengths)
            if tokens:
                parts = np.stack([model.flat(), trainer.past_flat.astype(np.float32)])
                yield carried(TaskContext.get().partitionId(), tokens, parts, rows, trainer.met).to_batches()[0]
            tidy()

        def mean(group: pa.Table) -> pa.Table:
            group = group.sort_by("part")  # so that sums, and scores, are the same in every run
            w = np.array(group.column("tokens").to_pylist())
            parts, rows, met = np.zeros((2, dense)), np.zeros((2, n_rows, DIM + 1)), np.zeros(n_rows)
            for x, p, r, m in zip(w, *(group.column(c).to_pylist() for c in ("parts", "rows", "met")), strict=True):
                often = np.frombuffer(m, np.float32) + 1e-3  # a slot that no task met keeps its value
                parts += x * np.frombuffer(p, np.float32).reshape(2, -1)
                rows += often[None, :, None] * np.frombuffer(r, np.float32).reshape(2, n_rows, -1)
                met += often
            return carried(group.column("part")[0].as_py(), w.sum(), parts / w.sum(), rows / met[None, :, None], met)

        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == number)
        trained = part.mapInArrow(run, CARRIED)
        # In two levels, of about the root of the number of tasks; one model goes to the driver.
        groups = max(8, math.isqrt(part.rdd.getNumPartitions()))
        found = trained.groupBy(F.pmod("part", F.lit(groups)).alias("g")).applyInArrow(mean, CARRIED).groupBy(F.lit(0).alias("g")).applyInArrow(mean, CARRIED).first()
        held.unpersist()
        if found:
            parts, rows = np.frombuffer(found["parts"], np.float32).reshape(2, -1), np.frombuffer(found["rows"], np.float32).reshape(2, n_rows, -1)
    return Model.of(parts[0], rows[0], vocabulary.first)


def carried(part: int, tokens: float, parts: np.ndarray, rows: np.ndarray, met: np.ndarray) -> pa.Table:
    raw = [pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (parts, rows, met)]
    return pa.table([pa.array([part], pa.int64()), pa.array([float(tokens)]), *raw], ["part", "tokens", "parts", "rows", "met"])


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    """The head words and the buckets' sums, over all words that have no class of their own.

    The head are the words, of HEAD_BYTES at most, of the highest frequency bands (64 to a factor of e) that hold HEAD words
    at most together; longer ones are looked up in the table of counts like all others. Bands are counted first, so no more than the head leaves the executors.
    """
    band = F.floor(F.log(F.col("c").cast("double")) * 64)
    least, n = 10**9, 0
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    for r in sorted(short.groupBy(band.alias("b")).count().collect(), key=lambda r: -r["b"]):
        n += r["count"]
        if n > HEAD:
            break
        least = r["b"]
    head = sorted(short.where(band >= least).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    own = [bytes(r["word"]) for r in head[:OWN]]
    tail_class = F.lit(OWN + 1) + F.pmod(F.crc32(F.expr("substring(word, -3)")), F.lit(BUCKETS))
    sums = counts.withColumn("g", tail_class).groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    mass, others = np.ones(CLASSES), np.ones(CLASSES)
    for r in sums:
        mass[r["g"]] += r["c"]
        others[r["g"]] += r["c"] + r["n"]
    for i, r in enumerate(head[:OWN]):
        g = bucket_class(own[i])
        mass[i] += r["c"]
        mass[g] -= r["c"]
        others[g] -= r["c"] + 1
    mass[END] += n_texts
    listed: list[list[tuple[bytes, int]]] = [[] for _ in range(BUCKETS)]
    for r in head[OWN : OWN + OUT]:
        if r["c"] >= LEAST:
            w = bytes(r["word"])
            listed[bucket_class(w) - OWN - 1].append((w, r["c"] + 1))
    inside = []
    for g, some in enumerate(listed):
        inside += [others[g + OWN + 1] - sum(c for _, c in some), *(c for _, c in some)]
    first = np.concatenate([[0], np.cumsum([1 + len(x) for x in listed])])
    return Vocabulary(own, {bytes(r["word"]): math.log10(r["c"] + 1) for r in head}, [w for x in listed for w, _ in x], first, mass / mass.sum(), np.array(inside, np.float64))


def tallied(words: pa.Array, lengths: np.ndarray) -> pa.ListArray:
    """The words of texts in a row, and how many each has -> for each text its distinct words, and how often it has them."""
    coded = words.dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(key % size)), pa.array(times, pa.int64())], ["word", "times"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(lengths) + 1) * size), pa.int32()), pairs)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score; learn: which rows are learnt from."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    chosen = texts.where(learn).select("text")
    counts = written(word_counts(chosen), "lm-counts")
    n_texts = chosen.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + n_texts, distinct + (n_texts > 0)
    v = vocabulary(counts, n_texts)
    model = fit(chosen, v)
    held = docs.sparkSession.sparkContext.broadcast((v.plain(), model.flat(), model.rows))
    end_log = math.log10(n_texts + 1)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known_words = Vocabulary.carried(*held.value[0])
        m, at = Model.of(held.value[1], held.value[2], v.first), TaskContext.get().partitionId() << 36
        others = v.other_logs()
        for b in batches:
            done = 0
            for pack in packs(b.column(1)):
                words, n = words_of(pack)
                cls, slot, log, base = known_words.columns(words)
                ends = np.append(0, np.cumsum(n))
                neural = m.log_probs(*stream(cls, slot, n)) / math.log(10)
                # A word in the slot of all others has its share of their counts; NaN: to be looked up in the table.
                shared = (slot >= 0) & (v.first[np.maximum(cls - OWN - 1, 0)] == slot)
                out = np.isnan(base)
                more = np.where(shared, np.where(out, 0.0, log) - others[cls], 0.0)
                cut = lambda x, w=n: np.add.reduceat(np.append(x, 0.0), np.append(0, np.cumsum(w))[:-1]) * (w > 0)
                missing = np.flatnonzero(out)
                before = np.searchsorted(missing, ends)
                tails = tallied(words.take(pa.array(missing)), np.diff(before))
                known = n - np.diff(before) + (n_texts > 0)
                columns = [pa.array(np.arange(at, at + len(n)), pa.int64()), b.column(0).slice(done, len(n)), pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(cut(np.nan_to_num(base)) + end_log), pa.array(cut(neural, n + 1) + cut(more)), tails]
                at, done = at + len(n), done + len(n)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "neural", "tail"])
        tidy()

    rows = written(texts.mapInArrow(run, f"row long, doc_id {id_type}, n_tokens long, known long, base double, neural double, tail array<struct<word:binary,times:long>>"), "lm-rows")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    rare = tail.join(counts, "word").select("row", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"))
    rare = rare.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("more").alias("more"))
    out = rows.drop("tail").join(rare, "row", "left")
    extra, per = F.coalesce("more", F.lit(0.0)), math.log10(total + distinct + 1)
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * per).alias("base_score"),
        (F.col("neural") + extra).alias("score"),
    )
