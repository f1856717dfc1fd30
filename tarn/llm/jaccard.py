"""Exact Jaccard self-join of word n-gram sets, with token-combination prefixes, as classes of linked documents.

1. Each text becomes the set of its shingles (64-bit hashes of k consecutive words), once; documents with
   equal sets share a digest and are one node from here on.
2. Texts are packed, and a pack's distinct shingles dealt out by hash to buckets of about two million; a bucket
   adds up in how many texts each occurs and returns the repeated ones to their packs. A pack sends a shingle once,
   with the number of its texts that have it, and keeps their list in a row of its own; so a shingle of all texts is
   as many entries as there are packs. A shingle of one text can make no link. (Copies in different packs count
   apart, so theirs are repeated; that costs, but loses nothing.)
3. Under the order (count, hash), a node takes the shortest prefix of its set from which no deletion
   of as many shingles as a linked set may lack removes every signature. Signatures are single rare
   shingles, and pairs of frequent ones within one of G classes: m frequent shingles of a class must
   lose m - 1 before their pairs are gone, so prefixes with pairs are longer and their lists shorter.
   G depends on the size class (sizes within a factor of RATIO); a node also indexes in the next class
   where its partners may be there, so any two linkable nodes meet in the larger one's class.
4. Nodes that share signatures form candidate groups (components of star edges). A group is compared
   in pairs of blocks (of BLOCK to MOST_BLOCK nodes and at most BLOCK_BYTES of shingles, on average) by counting common
   repeated shingles, which is exact; each task returns a spanning forest and link counts, never the pairs. Links' components
   are the classes. Every link is counted, so a group of m different texts that are all alike costs m * m / 2
   comparisons; what is moved for it is its shingles once for each of its blocks, of which there are BLOCKS up to
   131,072 texts.

No group is collected whole, no pair is emitted, and nothing is capped; joins treat keys that many rows share (the
digest of a much copied text, the root of a large group) apart (see common.keyed_join). Shingles are compared by hash
(bucket and 40 bits); the chance that two given sets of 500 words show a false common one is below 1e-8.

Defined cases: null or blank texts have no shingles and no links; a text of fewer than k words is one
shingle; texts of any length are read whole; documents with equal sets are linked to one another; a null doc_id
never names a class, and one whose class has only null ids gets null; repeated rows count as documents of their own;
an empty table gives an empty result; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keyed_join, texts_of, tidy, written
from .graph import components

#: Shingles in a bucket, on average; least ratio of a size class; most nodes that share a rare shingle.
BUCKET, RATIO, RARE = 1 << 21, 1.5, 8
#: Nodes in a block of a small group, of a large one, and the blocks before they grow; bytes of a block's shingles.
BLOCK, MOST_BLOCK, BLOCKS, BLOCK_BYTES = 256, 2048, 64, 8 << 20
#: Bytes of text to a shingle, about, from which the number of buckets follows.
TEXT_BYTES = 6
#: Hashed words that a worker remembers before it forgets all of them; most shingles (but for the last text's) and texts of a pack.
MEMO, PACK_SHINGLES, PACK_DOCS = 200_000, 1 << 20, 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, memo: Words) -> np.ndarray:
    """The sorted set of hashes of k-word shingles; words are lower-cased in A-Z and split at ASCII white space."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.array([], np.uint64)
    if len(memo) > MEMO:
        memo.clear()
    w = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    width = min(k, len(w))
    out = w[: len(w) - width + 1].copy()
    for j in range(1, width):
        out = out * MIX + w[j : len(w) - width + 1 + j]
    return np.unique(mixed(out + np.uint64(width)))


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


#: Bytes of a digest; of a shingle in a bucket.
DIGEST, LOW = 16, 5


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: str, width: int = 1) -> np.ndarray:
    """All bytes of a column of binaries as rows of width items, without a Python object for each."""
    parts = []
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        if len(c) and ends[-1] > ends[0]:
            parts.append(np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    flat = np.concatenate(parts) if parts else np.array([], np.uint8)
    return flat.view(dtype) if width == 1 else flat.view(dtype).reshape(-1, width)


def steps(x: np.ndarray) -> bytes:
    """An ascending run of small numbers as differences."""
    return np.diff(x, prepend=0).astype("<u2").tobytes()


#: In place of a text's number: the shingle is in several texts of the pack, which the pack's own row lists.
SEVERAL = 0xFFFF
PACK = ["bucket", "pack", "docs", "lows", "times", "ids", "which", "keys", "owners"]
NONE = 0xFFFFFFFF  # for a text without shingles


def packed_schema(docs: DataFrame, more: str = "") -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"bucket long, pack long, docs binary, lows binary, times binary, ids array<{kind}>, which binary, keys binary, owners binary{more}"


def whole_keys(bucket: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    """A shingle's bucket (24 bits) and LOW bytes, as one number."""
    return (np.asarray(bucket, np.uint64) & np.uint64(0xFFFFFF)) << np.uint64(8 * LOW) ^ low


def wide(raw: np.ndarray) -> np.ndarray:
    """Rows of LOW bytes as numbers."""
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :LOW] = raw
    return out.view("<u8").ravel()


def dealt(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """docs (doc_id, text) -> packs of up to PACK_DOCS texts. A pack has one row for each bucket: docs (the number in the
    pack of the text that has the shingle, or SEVERAL, as steps of 2 bytes), lows (LOW bytes for each shingle), times (4
    bytes for each of SEVERAL: how many texts); and one with a negative bucket of its own: docs (its digests), lows (its
    set sizes), ids and which (all its rows' ids, and the number of their text), keys, times and owners (the shingles of
    several texts, and which). A pack is named by the partition and its place there, so a task that runs again makes
    the same packs."""
    docs = docs.select("doc_id", "text")

    def flush(sets: dict[bytes, np.ndarray], ids: list[pa.Array], which: list[int], pack: int) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets.values()], np.uint32)
        h, owner = np.concatenate([*sets.values(), np.array([], np.uint64)]), np.repeat(np.arange(len(n), dtype=np.uint16), n)
        by = np.argsort(h, kind="stable")
        h, owner = h[by], owner[by]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.array([], np.int64)
        times = np.diff(np.append(starts, len(h))).astype("<u4")
        d, first = h[starts], np.where(times > 1, SEVERAL, owner[starts]).astype(np.uint16) if len(h) else np.array([], np.uint16)
        bucket = (d >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(d), np.int64)
        raw = d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW]
        key = whole_keys(bucket, wide(raw))
        again = np.flatnonzero(times > 1)
        again = again[np.argsort(key[again])]
        owners = np.concatenate([*(owner[starts[i] : starts[i] + times[i]] for i in again), np.array([], np.uint16)])
        rows: tuple[list, ...] = ([-pack - 1], [b"".join(sets)], [n.astype("<u4").tobytes()], [times[again].tobytes()])
        own_keys = key[again].astype("<u8").tobytes()
        order = np.lexsort((first, bucket))
        bucket, first, raw, times = bucket[order], first[order], raw[order], times[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        for s, e in zip(cuts, [*cuts[1:], len(bucket)], strict=True):
            for out, x in zip(rows, (int(bucket[s]), steps(first[s:e]), raw[s:e].tobytes(), times[s:e][first[s:e] == SEVERAL].tobytes()), strict=True):
                out.append(x)
        m = len(cuts)
        flat = pa.concat_arrays(ids)
        listed = pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat), pa.nulls(m, pa.list_(flat.type))])
        own = lambda x: pa.array([x, *[None] * m], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int64()), pa.array([pack] * (m + 1), pa.int64()), *(pa.array(r, pa.binary()) for r in rows[1:]), listed, own(np.array(which, "<u4").tobytes()), own(own_keys), own(owners.astype("<u2").tobytes())],
            PACK,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        memo, pack = Words(), TaskContext.get().partitionId() << 32
        sets: dict[bytes, np.ndarray] = {}
        number: dict[bytes, int] = {}
        ids, which, held = [], [], 0
        for b in batches:
            at = 0
            for i, t in enumerate(texts_of(b.column(1))):
                s = shingles(t, k, memo)
                if len(s):
                    d = digest(s)
                    if d not in sets:
                        sets[d], number[d] = s, len(number)
                        held += len(s)
                    which.append(number[d])
                else:
                    which.append(NONE)
                if held > PACK_SHINGLES or len(which) == PACK_DOCS:
                    yield flush(sets, [*ids, b.column(0).slice(at, i + 1 - at)], which, pack)
                    sets, number, ids, which, held, pack, at = {}, {}, [], [], 0, pack + 1, i + 1
            ids.append(b.column(0).slice(at))
        if which:
            yield flush(sets, ids, which, pack)
        sets, memo = {}, Words()
        tidy()

    return docs.mapInArrow(run, packed_schema(docs))


def counted(group: pa.Table) -> pa.Table:
    """A bucket's rows -> for each pack with repeated shingles in it: bucket, pack, docs, lows, counts (1 byte, 255: or more)."""
    number = group.column("bucket")[0].as_py()
    if number < 0:
        return group.append_column("counts", pa.array([b""] * len(group), pa.binary()))
    docs = [np.cumsum(np.frombuffer(x, "<u2"), dtype=np.uint16) for x in group.column("docs").to_pylist()]
    raw = unpacked(group.column("lows"), "u1", LOW)
    low = wide(raw)
    owner = np.concatenate(docs)
    times = np.ones(len(low), np.int64)
    times[owner == SEVERAL] = unpacked(group.column("times"), "<u4")
    by = np.argsort(low, kind="stable")
    ordered = low[by]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.minimum(np.add.reduceat(times[by], starts), 255).astype(np.uint8)
    count = np.empty(len(by), np.uint8)
    count[by] = np.repeat(total, np.diff(np.append(starts, len(by))))
    del by, ordered, low, times
    rows: tuple[list, list, list, list] = ([], [], [], [])
    at = 0
    for pack, mine in zip(group.column("pack").to_pylist(), docs, strict=True):
        again = count[at : at + len(mine)] > 1
        if again.any():
            for out, x in zip(rows, (pack, steps(mine[again]), raw[at : at + len(mine)][again].tobytes(), count[at : at + len(mine)][again].tobytes()), strict=True):
                out.append(x)
        at += len(mine)
    columns = {"bucket": pa.array([number] * len(rows[0]), pa.int64()), "pack": pa.array(rows[0], pa.int64())} | {c: pa.array(r, pa.binary()) for c, r in zip(("docs", "lows", "counts"), rows[1:], strict=True)}
    return pa.table([columns[f.name] if f.name in columns else pa.nulls(len(rows[0]), f.type) for f in [*group.schema, pa.field("counts", pa.binary())]], [*PACK, "counts"])


def ratio_of(num: int, den: int) -> float:
    """The ratio of size classes: linked sets are in the same or neighbouring ones."""
    return max(RATIO, den / num)


def size_class(n: np.ndarray | int, ratio: float) -> np.ndarray:
    return np.floor(np.log(n) / math.log(ratio) + 1e-9).astype(np.int64)


def lacking(n: int, num: int, den: int) -> int:
    """How many of n shingles a linked set may lack: n less the least overlap, num / den of n rounded up."""
    return n - -(-num * n // den)


def groups_of(tag: int, num: int, den: int) -> int:
    """Classes of frequent shingles in a size class; 0: single shingles only.

    They are fewer than the shingles that linked sets share at least, so that two of these meet in a class.
    """
    n = ratio_of(num, den) ** tag
    least = math.ceil(num * n / den - 1e-9)
    return 0 if n < 40 or least < 2 else min(least - 1, max(1, round((den - num) / den * n / 4)))


def signatures(n: int, keys: np.ndarray, counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """The node's signatures in its size class and, if its partners reach it, in the next; none if it can't be linked.

    keys and counts: its repeated shingles, by (count, key); the n - len(keys) others come before them.
    """
    need = lacking(n, num, den) + 1 - (n - len(keys))
    if need <= 0:
        return np.array([], np.uint64)
    ratio = ratio_of(num, den)
    own = int(size_class(n, ratio))
    out = []
    for tag in (own, own + 1):
        if tag > own and size_class(max(1, den * n // num), ratio) < tag:
            break
        g = groups_of(tag, num, den)
        paired = counts > RARE if g else np.zeros(len(keys), bool)
        where = (keys % np.uint64(g)).astype(np.int64) if g else np.zeros(len(keys), np.int64)
        # What each further shingle adds to the number of deletions: nothing if it is the first of its paired class.
        adds = np.ones(len(keys), np.int64)
        at = np.flatnonzero(paired)
        adds[at[np.unique(where[at], return_index=True)[1]]] = 0
        total = np.cumsum(adds)
        stop = int(np.searchsorted(total, need)) + 1
        k, p, w = keys[:stop], paired[:stop], where[:stop]
        salt = np.uint64((tag + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
        found = [mixed(k[~p] ^ salt)]
        for c in np.unique(w[p]):
            same = np.sort(k[p & (w == c)])
            i, j = np.triu_indices(len(same), 1)
            found.append(mixed(mixed(same[i] + salt) * MIX + same[j]))
        sigs = np.concatenate(found)
        # The last bit tells the two size classes apart, for the pair's own one.
        out.append((np.unique(sigs) & ~np.uint64(1)) | np.uint64(tag & 1))
    return np.concatenate(out)


def indexed(pack: pa.Table, num: int, den: int) -> pa.Table:
    """A pack's rows -> a row for each document (doc_id, n, digest), and for each of its texts that can be linked one
    (node set) with digest, n, keys (sorted) and sigs."""
    own, keys, counts = [], [], []
    buckets = pack.column("bucket").to_pylist()
    mine = buckets.index(min(buckets))  # the pack's own row
    take = lambda c: pack.column(c)[mine]
    read = lambda c, t: np.frombuffer(take(c).as_buffer(), t)
    digests, n, which = take("docs").as_py(), read("lows", "<u4"), read("which", "<u4")
    several, owners = read("keys", "<u8"), read("owners", "<u2")
    long = read("times", "<u4").astype(np.int64)
    from_ = np.cumsum(long) - long
    for bucket, docs, lows, times in zip(*(pack.column(c).to_pylist() for c in ("bucket", "docs", "lows", "counts")), strict=True):
        if bucket < 0:
            continue
        owner, count = np.cumsum(np.frombuffer(docs, "<u2"), dtype=np.uint16), np.frombuffer(times, np.uint8)
        key = whole_keys(bucket, wide(np.frombuffer(lows, np.uint8).reshape(-1, LOW)))
        more = owner == SEVERAL
        at = np.searchsorted(several, key[more])
        each = long[at]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(from_[at], each)
        own += [owner[~more], owners[place]]
        keys += [key[~more], np.repeat(key[more], each)]
        counts += [count[~more], np.repeat(count[more], each)]
    rows: tuple[list, list, list, list] = ([], [], [], [])
    if own:
        owner, key, count = np.concatenate(own), np.concatenate(keys), np.concatenate(counts)
        by = np.lexsort((key, count, owner))
        owner, key, count = owner[by], key[by], count[by]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else []
        for s, e in zip(starts, [*starts[1:], len(owner)], strict=True):
            i = int(owner[s])
            if len(sigs := signatures(int(n[i]), key[s:e], count[s:e], num, den)):
                for out, x in zip(rows, (digests[DIGEST * i : DIGEST * (i + 1)], int(n[i]), np.sort(key[s:e]).tobytes(), sigs.view(np.int64)), strict=True):
                    out.append(x)
    ids = take("ids").values
    m, all_ = len(rows[0]), len(ids)
    some = which != NONE
    sizes = np.zeros(all_, np.int64)
    sizes[some] = n[which[some]]
    names = [digests[DIGEST * i : DIGEST * (i + 1)] if i != NONE else None for i in which.tolist()]
    nothing = lambda t: pa.nulls(all_, t)
    return pa.table(
        [
            pa.array([False] * all_ + [True] * m),
            pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
            pa.array([*sizes.tolist(), *rows[1]], pa.int64()),
            pa.array([*names, *rows[0]], pa.binary()),
            pa.concat_arrays([nothing(pa.binary()), pa.array(rows[2], pa.binary())]),
            pa.concat_arrays([nothing(pa.list_(pa.int64())), pa.array(rows[3], pa.list_(pa.int64()))]),
        ],
        ["node", "doc_id", "n", "digest", "keys", "sigs"],
    )


#: A key of so many pairs of a block's nodes is counted by a matrix product, others pair by pair; pairs at a time.
HEAVY, PAIRS = 1 << 14, 1 << 21


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: keys that few have are counted pair by pair, the others by
    products of 0/1 matrices."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    out = np.zeros(len(left) * len(right), np.float32)
    if not len(common):
        return out.reshape(len(left), len(right))

    def placed(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By key: its number in common, the owner; and how many owners each key has."""
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        ok = common[at] == flat
        at, owner = at[ok], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok]
        by = np.argsort(at, kind="stable")
        return at[by], owner[by], np.bincount(at, minlength=len(common))

    (ka, oa, fa), (kb, ob, fb) = placed(left, a), placed(right, b)
    heavy = fa * fb >= HEAVY
    start = np.cumsum(fb) - fb
    light = np.flatnonzero(~heavy[ka])
    ends = np.cumsum(fb[ka[light]])
    done = 0
    while done < len(light):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, side="right")))
        some = light[done:upto]
        each = fb[ka[some]]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start[ka[some]], each)
        out += np.bincount(np.repeat(oa[some], each) * len(right) + ob[place], minlength=len(out)).astype(np.float32)
        done = upto
    out = out.reshape(len(left), len(right))
    cut = np.flatnonzero(heavy)
    for i in range(0, len(cut), 1024):
        some = cut[i : i + 1024]

        def matrix(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(some, keys), len(some) - 1)  # noqa: B023
            ok = some[at] == keys  # noqa: B023
            m = np.zeros((n, len(some)), np.float32)  # noqa: B023
            m[owner[ok], at[ok]] = 1
            return m

        out += matrix(ka, oa, len(left)) @ matrix(kb, ob, len(right)).T
    return out


def linked(group: pa.Table, num: int, den: int) -> pa.Table:
    """Two blocks of a candidate group -> node, root (of a spanning forest of the links found), links (its number, copies included)."""
    cols = {c: group.column(c).to_pylist() for c in group.column_names}
    tag, same = cols["tag"][0], cols["one"][0] == cols["two"][0]
    side = [[i for i, x in enumerate(cols["side"]) if x == s] for s in (0, 1)]
    left, right = side[0], side[0] if same else side[1]
    out: tuple[list, list, list] = ([], [], [])
    if left and right:
        keys = [np.frombuffer(k, "<u8") for k in cols["keys"]]
        n, copies = np.array(cols["n"]), np.array(cols["copies"])
        common = overlaps([keys[i] for i in left], [keys[i] for i in right])
        a, b = n[left][:, None], n[right][None, :]
        ok = common * den >= num * (a + b - common)
        ratio = ratio_of(num, den)
        ok &= np.maximum(size_class(a, ratio), size_class(b, ratio)) == tag
        if same:
            np.fill_diagonal(ok, False)
        root = list(range(len(n)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*np.nonzero(ok), strict=True):
            root[find(left[i])] = find(right[j])
        degree = np.zeros(len(n), np.int64)
        degree[left] += (ok * copies[right][None, :]).sum(axis=1)
        if not same:
            degree[right] += (ok * copies[left][:, None]).sum(axis=0)
        for i in np.flatnonzero(degree):
            for x, y in zip(out, (cols["digest"][i], cols["digest"][find(i)], int(degree[i])), strict=True):
                x.append(y)
    return pa.table([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["digest", "root", "links"])


def trimmed(work: Callable[..., pa.Table], *args: Any) -> pa.Table:
    """work(*args), whose temporary arrays go back to the system before the next group comes."""
    out = work(*args)
    tidy()
    return out


def join_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, n_links; links where den * common >= num * union."""
    docs = docs.select("doc_id", "text")
    amount = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(24, max(0, round(math.log2(max(1, amount / TEXT_BYTES / BUCKET)))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    again = dealt(docs, k, bits).groupBy("bucket").applyInArrow(lambda t: trimmed(counted, t), packed_schema(docs, ", counts binary"))
    index = written(again.groupBy("pack").applyInArrow(lambda t: trimmed(indexed, t, num, den), f"node boolean, doc_id {kind}, n long, digest binary, keys binary, sigs array<long>"), "jaccard-index")
    base = index.where("not node").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    reps = base.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = index.where("node")

    tagged = nodes.select("digest", F.explode("sigs").alias("sig"))
    star = tagged.groupBy("sig").agg(F.min("digest").alias("b"), F.max("digest").alias("top"), F.count("*").alias("count")).where("b <> top")
    star = written(star.select("sig", "b", "count"), "jaccard-stars")
    # A node is there once for each of its two possible size classes: the digest and the last bit of the signature.
    node = lambda d: F.concat(d, F.when(F.col("sig") % 2 == 0, F.lit(b"\0")).otherwise(F.lit(b"\1")))
    edges = keyed_join(tagged, star.select("sig", "b"), "sig", star).select(node(F.col("digest")).alias("a"), node(F.col("b")).alias("b"))
    groups = components(edges)
    placed = groups.select("root", F.substring("node", 1, DIGEST).alias("digest"), F.when(F.substring("node", DIGEST + 1, 1) == F.lit(b"\1"), 1).otherwise(0).alias("odd"))
    lengths = nodes.groupBy("digest").agg(F.max(F.octet_length("keys")).alias("bytes"))
    placed = written(placed.join(lengths, "digest"), "jaccard-groups")
    counts = placed.groupBy("root").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes"))
    size = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), F.ceil(F.col("count") / BLOCKS)))
    blocks = counts.select("root", F.greatest(F.ceil(F.col("count") / size), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks"))
    placed = keyed_join(placed, blocks, "root", counts).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks"))
    known = nodes.select("digest", "n", "keys").join(placed.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    held = placed.join(known, "digest").join(reps.select("digest", "copies"), "digest")
    own = F.floor(F.log(F.col("n").cast("double")) / math.log(ratio_of(num, den)) + 1e-9)
    held = held.withColumn("tag", F.when(F.pmod(own, F.lit(2)) == F.col("odd"), own).otherwise(own + 1).cast("long"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("one"), F.greatest("block", o).alias("two"), (F.col("block") > o).cast("int").alias("side")))
    held = held.select("root", "digest", "n", "keys", "copies", "tag", F.explode(pairs).alias("p")).select("root", "digest", "n", "keys", "copies", "tag", "p.*")
    found = held.groupBy("root", "one", "two").applyInArrow(lambda t: linked(t, num, den), "digest binary, root binary, links long")
    found = written(found, "jaccard-links")

    joined = written(components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))).join(reps, F.col("node") == F.col("digest")).select("root", "digest", "rep"), "jaccard-classes")
    by_class = joined.groupBy("root").agg(F.min("rep").alias("component"), F.count("*").alias("count"))
    degree = found.groupBy("digest").agg(F.sum("links").alias("links"))
    wide_ = keyed_join(joined, by_class.drop("count"), "root", by_class).select("digest", "component").join(degree, "digest", "left")
    whole = reps.join(wide_, "digest", "left").select("digest", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    full = keyed_join(base.where("n_shingles > 0"), whole, "digest", reps.withColumnRenamed("copies", "count")).select("doc_id", "n_shingles", "component_id", "n_links")
    return full.unionByName(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
