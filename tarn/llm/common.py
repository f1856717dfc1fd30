"""Pieces shared by the operators: word patterns, shared storage, native helpers."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words between ASCII white space (blank, tab to carriage return).
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder. On a
    local master, where driver and executors are one process, one of our own serves if neither is set (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, goes with the JVM or by dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a written() table that nothing reads any more."""
    spark = table.sparkSession
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Keys that keyed_join() treats apart, at most; rows that a key has at least for that.
HOT_KEYS, HOT_ROWS = 256, 1000


def keyed_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame) -> DataFrame:
    """left joined with right by key, of which right has one row for each; counts: key, count (rows of left).

    Rows of left that share one of the HOT_KEYS most frequent keys stay where they are and get that key's row of right
    by broadcast, HOT_KEYS rows at most; all other keys have less than a HOT_KEYS-th of left's rows. left is read
    twice, so it should be a table or cheap.
    """
    often = counts.where(F.col(key).isNotNull() & (F.col("count") >= HOT_ROWS)).select(key, "count")
    hot = [bytes(k) if isinstance(k, bytearray) else k for k, _ in often.orderBy(F.desc("count"), key).limit(HOT_KEYS).collect()]
    if not hot:
        return left.join(right, key)
    among = F.col(key).isin([F.lit(k) for k in hot])
    return left.where(~among).join(right.where(~among), key).unionByName(left.where(among).join(F.broadcast(right.where(among)), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array, rows: int = 500) -> Iterator[Any]:
    """A column's values, few Python objects at a time."""
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that few of its texts are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def tidy() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, beside others on their machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def kept() -> dict[str, Any]:
    """What operators keep in a Python worker from task to task."""
    return sys.modules.setdefault("_tarn_worker", types.ModuleType("_tarn_worker")).__dict__


def forget() -> None:
    """Lets go of what another operator keeps in this worker, which is made again should that one come back."""
    if kept().pop("codec", None):
        tidy()


#: Bytes of an Arrow batch for a Python worker, about; Spark's own bound is 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends at most about BATCH_BYTES to a Python worker at once, or less if that is set already.

    A task holds a batch and its result in native memory, beside the heap, and once more in its worker. Batches of Spark's
    own bound are 10,000 texts; the same rows arrive in smaller ones.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; null ids count as remainder 1, so they are never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(m)), F.lit(1))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def extended(docs: DataFrame, **more: str) -> tuple[DataFrame, T.StructType]:
    """docs without columns named as the new ones (results replace them), and its schema with the new ones."""
    docs = docs.drop(*more)
    return docs, T.StructType([*docs.schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items())])
