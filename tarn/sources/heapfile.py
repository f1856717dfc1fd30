"""The paged file format, as a Spark data source ("heapfile") that reads page ranges in parallel.

A page of 4096 bytes begins with a bitmap, a bit for each slot, least significant first; slots of
fixed width follow. Whole numbers are 4 bytes, big-endian and signed; strings a 4-byte length and 128
bytes of Latin-1. Every page is read, empty ones in between and a short last one included.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..errors import EngineError
from ..types import PAGE_BYTES, STRING_BYTES, Type, row_bytes


def slots_per_page(s: T.StructType) -> int:
    """How many rows fit, each with one bit of the bitmap."""
    return PAGE_BYTES * 8 // (row_bytes(s) * 8 + 1)


def header_bytes(s: T.StructType) -> int:
    return -(-slots_per_page(s) // 8)


def layout(s: T.StructType) -> np.dtype:
    fields: list[tuple] = []
    for i, f in enumerate(s.fields):
        fields += [(f"n{i}", ">i4")] if Type.of(f.dataType) is Type.INT else [(f"n{i}", ">i4"), (f"s{i}", f"V{STRING_BYTES}")]
    return np.dtype(fields)


def decode_pages(raw: bytes, s: T.StructType, tests: Sequence[tuple[Callable, int, int]] = ()) -> pa.RecordBatch:
    """The used slots of whole pages, in order; of those only the rows that pass tests (comparison, field number, value)."""
    kind, slots, head = layout(s), slots_per_page(s), header_bytes(s)
    pages = np.frombuffer(raw, np.uint8).reshape(-1, PAGE_BYTES)
    used = np.unpackbits(pages[:, :head], axis=1, bitorder="little")[:, :slots].astype(bool)
    body = np.ascontiguousarray(pages[:, head : head + slots * kind.itemsize]).view(kind).reshape(len(pages), slots)
    found = body[used]
    for test, i, value in tests:
        found = found[test(found[f"n{i}"].astype(np.int64), value)]
    columns = []
    for i, f in enumerate(s.fields):
        n = found[f"n{i}"].astype(np.int32)
        if Type.of(f.dataType) is Type.INT:
            columns.append(pa.array(n))
        else:
            columns.append(texts(found[f"s{i}"], n))
    return pa.RecordBatch.from_arrays(columns, names=list(s.names))


def texts(raw: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Fixed-width Latin-1 fields and their lengths -> strings; of bytes over 127 UTF-8 makes two."""
    field = np.frombuffer(raw.tobytes(), np.uint8).reshape(len(raw), STRING_BYTES)
    kept = np.arange(STRING_BYTES) < np.clip(lengths, 0, STRING_BYTES)[:, None]
    high = kept & (field > 127)
    sizes = kept.sum(axis=1) + high.sum(axis=1)
    flat, twice = field[kept], high[kept]
    out = np.repeat(flat, 1 + twice)
    second = np.flatnonzero(twice) + np.arange(1, int(twice.sum()) + 1)
    out[second - 1], out[second] = 0xC0 | flat[twice] >> 6, 0x80 | flat[twice] & 0x3F
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(raw), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


#: Comparisons of whole numbers that a scan makes before it decodes strings.
PUSHED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


def encode_page(rows: Sequence[Sequence[Any]], s: T.StructType) -> bytes:
    """Rows in the first slots of a page; more than fit is an error. Strings are cut at 128 bytes; what Latin-1 lacks becomes '?'."""
    slots, head = slots_per_page(s), header_bytes(s)
    if len(rows) > slots:
        raise EngineError(f"{len(rows)} rows for a page of {slots} slots")
    body = np.zeros(len(rows), layout(s))
    for i, f in enumerate(s.fields):
        if Type.of(f.dataType) is Type.INT:
            body[f"n{i}"] = [r[i] for r in rows]
        else:
            texts = [str(r[i]).encode("latin-1", "replace")[:STRING_BYTES] for r in rows]
            body[f"n{i}"] = [len(t) for t in texts]
            body[f"s{i}"] = np.frombuffer(b"".join(t.ljust(STRING_BYTES, b"\0") for t in texts), f"V{STRING_BYTES}") if texts else []
    bits = np.zeros(head * 8, np.uint8)
    bits[: len(rows)] = 1
    return (np.packbits(bits, bitorder="little").tobytes() + body.tobytes()).ljust(PAGE_BYTES, b"\0")


def write_pages(path: str, rows: Iterable[Sequence[Any]], s: T.StructType) -> int:
    """Rows, a page at a time, to one file; how many."""
    n, page, slots = 0, [], slots_per_page(s)
    with open(path, "wb") as f:
        for r in rows:
            page.append(tuple(r))
            n += 1
            if len(page) == slots:
                f.write(encode_page(page, s))
                page = []
        if page or not n:
            f.write(encode_page(page, s))
    return n


@dataclass
class PageRange(InputPartition):
    path: str
    first: int
    last: int


class HeapReader(DataSourceReader):
    #: Pages that one task reads, and that it decodes at a time.
    TASK, AT_ONCE = 4096, 256

    def __init__(self, path: str, s: T.StructType) -> None:
        self.path, self.s = path.removeprefix("file://"), s
        self.tests: list[tuple[Callable, int, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons of whole numbers; yields the others."""
        for f in filters:
            test = PUSHED.get(type(f))
            if test and len(f.attribute) == 1 and isinstance(f.value, int) and Type.of(self.s[f.attribute[0]].dataType) is Type.INT:
                self.tests.append((test, self.s.names.index(f.attribute[0]), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.dat"))) if os.path.isdir(self.path) else [self.path]
        out = []
        for f in files:
            pages = -(-os.path.getsize(f) // PAGE_BYTES)
            out += [PageRange(f, a, min(pages, a + self.TASK)) for a in range(0, pages, self.TASK)]
        return out or [PageRange("", 0, 0)]

    def read(self, partition: PageRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            f.seek(partition.first * PAGE_BYTES)
            for a in range(partition.first, partition.last, self.AT_ONCE):
                raw = f.read((min(partition.last, a + self.AT_ONCE) - a) * PAGE_BYTES)
                yield decode_pages(raw + b"\0" * (-len(raw) % PAGE_BYTES), self.s, self.tests)


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class HeapWriter(DataSourceArrowWriter):
    """Each task writes one file under a name of its own, which commit makes visible."""

    def __init__(self, path: str, s: T.StructType) -> None:
        self.path, self.s = path.removeprefix("file://"), s

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"_part-{uuid.uuid4().hex}.tmp")
        rows = (r for b in iterator for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        return Part(name, write_pages(name, rows, self.s))

    def commit(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m:
                os.replace(m.path, m.path.replace("_part-", "part-").replace(".tmp", ".dat"))

    def abort(self, messages: list[Part | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class HeapSource(DataSource):
    """format("heapfile"): a file, or a folder of .dat files, with a schema of ints and strings."""

    @classmethod
    def name(cls) -> str:
        return "heapfile"

    def schema(self) -> T.StructType:
        raise EngineError("a paged file needs a declared schema")

    def reader(self, schema: T.StructType) -> HeapReader:
        return HeapReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> HeapWriter:
        return HeapWriter(self.options["path"], schema)


def register(spark: SparkSession) -> None:
    """The source's name for the session, and filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HeapSource)


def read_heap(spark: SparkSession, path: str, s: T.StructType) -> DataFrame:
    register(spark)
    return spark.read.format("heapfile").schema(s).load(path)


def write_heap(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("heapfile").mode("append").save(path)


def split_heap(path: str, s: T.StructType, parts: int, folder: str) -> list[str]:
    """A file's rows in contiguous ranges, of sizes that differ by one at most, as parts files in a folder; page by page."""
    from ..operators.exchange import ranges

    def each() -> Iterator[tuple]:
        with open(path, "rb") as f:
            while raw := f.read(PAGE_BYTES):
                batch = decode_pages(raw.ljust(PAGE_BYTES, b"\0"), s)
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    total = sum(1 for _ in each())
    os.makedirs(folder, exist_ok=True)
    rows, out = each(), []
    for i, (a, b) in enumerate(ranges(total, parts)):
        out.append(os.path.join(folder, f"{i}.dat"))
        write_pages(out[-1], (next(rows) for _ in range(b - a)), s)
    return out
