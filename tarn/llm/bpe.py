"""Byte-level BPE encoding and decoding from a rank file.

Two tiers: a minimal perfect hash answers for pre-tokens that are vocabulary entries; any other one is
merged with a heap of pairs (rank, position) over a doubly linked list of byte runs. Results for
pre-tokens are remembered in a table of bounded size in each worker process.

Defined cases: a null text is empty, with no ids; texts of any length are encoded whole; nothing is special; repeated
rows are coded each; an empty table gives an empty result; other columns pass through, but those named like the results
are replaced by them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import extended, kept, texts_of

#: Pre-tokens that a worker remembers before it forgets all of them, and the longest one it remembers.
MEMO, MEMO_CHARS = 800_000, 64
#: Keys in a bucket of the perfect hash, on average.
BUCKET = 4


class PerfectHash:
    """Minimal perfect hash by displacement: key -> its number in keys, or -1 for any other bytes.

    Keys go to buckets by their hash; a bucket, the largest first, takes the first displacement that
    sends all its keys to free slots. A bucket of one key takes a free slot directly (stored negative).
    """

    def __init__(self, keys: list[bytes], tables: tuple[list[int], list[int]] | None = None) -> None:
        n = self.n = len(keys)
        self.keys = keys
        self.buckets = max(1, n // BUCKET)
        if tables:
            self.shift, self.slots = tables
            return
        buckets: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, k in enumerate(keys):
            h = xxhash.xxh3_64_intdigest(k)
            buckets[h % self.buckets].append((h, i))
        self.shift, self.slots = [0] * self.buckets, [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(buckets[b]))
        singles = [b for b in order if len(buckets[b]) == 1]
        for b in order[: len(order) - len(singles) - sum(not x for x in buckets)]:
            d = 0
            while True:
                at = [self._slot(h, d) for h, _ in buckets[b]]
                if len(set(at)) == len(at) and all(self.slots[x] < 0 for x in at):
                    break
                d += 1
            self.shift[b] = d
            for x, (_, i) in zip(at, buckets[b], strict=True):
                self.slots[x] = i
        free = (x for x, i in enumerate(self.slots) if i < 0)
        for b in singles:
            x = next(free)
            self.shift[b], self.slots[x] = -x - 1, buckets[b][0][1]

    def _slot(self, h: int, d: int) -> int:
        h = (h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (h ^ h >> 31) % self.n

    def find(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        i = self.slots[-d - 1 if d < 0 else self._slot(h, d)]
        return i if i >= 0 and self.keys[i] == key else -1


class Codec:
    """encode: text -> ids; decode: ids -> bytes; from the lines of a rank file and a split pattern."""

    def __init__(self, ranks: bytes, pattern: str, tables: tuple[list[int], list[int]] | None = None) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.tokens = [base64.b64decode(t) for t, _ in pairs]
        self.ids = [int(r) for _, r in pairs]
        self.hash = PerfectHash(self.tokens, tables)
        self.by_id = dict(zip(self.ids, self.tokens, strict=True))
        self.rank = dict(zip(self.tokens, self.ids, strict=True)).get  # for the pairs of a merge
        self.split = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def _id(self, piece: bytes) -> int:
        i = self.hash.find(piece)
        return -1 if i < 0 else self.ids[i]

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece that is no entry: repeatedly the leftmost pair of the lowest rank is joined.

        end[i] is where the run that starts at i stops, prev[i] where the run before it starts; a run that
        was joined to its left neighbour has end 0. A pair on the heap is stale unless both its runs,
        and so its total extent, are still there.
        """
        n, rank = len(piece), self.rank
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, to = heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue
            end[j], end[i] = 0, to
            if to < n:
                prev[to] = i
                if (r := rank(piece[i : end[to]])) is not None:
                    heappush(heap, (r, i, end[to]))
            if (h := prev[i]) >= 0 and (r := rank(piece[h:to])) is not None:
                heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = end[i]
        return tuple(out)

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        whole = self._id(raw)
        ids = (whole,) if whole >= 0 else self.merged(raw)
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, add = self.memo.get, out.extend
        for p in self.split(text):
            add(known(p) or self.piece_ids(p))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


def shared(docs: DataFrame, ranks: str, pattern: str) -> Broadcast:
    """Broadcast arguments of Codec: the rank file, read by the driver, and the hash tables made from it there.

    A vocabulary has a fixed size, whatever the corpus: a few MB.
    """
    with open(ranks, "rb") as f:
        raw = f.read()
    made = Codec(raw, pattern).hash
    return docs.sparkSession.sparkContext.broadcast((raw, pattern, (made.shift, made.slots)))


def codec(held: Broadcast) -> Codec:
    """The worker's codec for these tables: it outlives the task, and with it what it remembers, until another operator forgets it."""
    here = kept()
    if here.get("codec", (None,))[0] != held.value[:2]:
        here["codec"] = (held.value[:2], Codec(*held.value))
    return here["codec"][1]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """docs -> their columns and ids (array of int). ranks: path of the rank file, read by the driver.

    check: name of a further column that tells whether the ids decode to the text's bytes.
    """
    held = shared(docs, ranks, pattern)
    docs, schema = extended(docs, **{ids: "array<int>"} | ({check: "boolean"} if check else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(held)
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                texts = [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
                found = [np.array(coder.encode(t), np.int32) for t in texts]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                more = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))]
                if check:
                    more.append(pa.array([coder.decode(x.tolist()) == t.encode() for t, x in zip(texts, found, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with ids -> their columns and the decoded bytes; null ids decode to nothing."""
    held = shared(docs, ranks, pattern)
    docs, schema = extended(docs, **{out: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(held)
        for b in batches:
            texts = [coder.decode(x or ()) for x in texts_of(b.column(b.schema.get_field_index(ids)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, + n_tokens, ids_sha256 (ids as little-endian 32-bit numbers), decoded_sha256.

    Encodes and decodes in one pass, so that neither ids nor bytes leave the worker.
    """
    held = shared(docs, ranks, pattern)
    kept = [c for c in docs.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    _, schema = extended(docs.select(*kept), n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(held)
        for b in batches:
            n, coded, back = [], [], []
            for t in texts_of(b.column(b.schema.get_field_index(text))):
                ids = coder.encode(t or "")
                n.append(len(ids))
                coded.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], schema.names)

    return docs.mapInArrow(run, schema)
