"""Shared plumbing: reading tables, staging tables in the shared folder, Arrow batches as numpy bytes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder is set for the session, in local mode only: on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="hanlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors.

    checkpoint() would run the plan twice (once to count, once to write). The files go when the JVM ends.
    """
    return _written(df, name)[0]


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """stage(df, name) whose files go at the block's end: nothing that is used later may read it."""
    rows, delete = _written(df, name)
    try:
        yield rows
    finally:
        delete()


def _written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], bool]]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hanlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path), lambda: files.delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1000 rows, where the session has Spark's default of 10,000: rows here are whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, 1_000)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(rows: DataFrame, most: int) -> DataFrame:
    """rows with a hint for joins: broadcast where they are at most ``most`` (counted), else merged by shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows.hint("merge")


def trim() -> None:
    """Gives freed memory and tables of powers back to the system: Python workers outlive their tasks, beside those of the next stages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def trimmed(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """of, with its memory given back at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from of(batches)
        finally:
            trim()

    return run


def _libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def plainly_named(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with all columns but the kept ones renamed by their places, so that none clashes; toDF(*docs.columns) names them back."""
    return docs.toDF(*(c if c in kept else f"column_{i}" for i, c in enumerate(docs.columns)))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and a key of the row's content: (k_id, k_text) is never null, so rows with null ids join too."""
    return docs.select(
        "doc_id", "text", *columns,
        F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("k_id"), F.xxhash64("text").alias("k_text"),
    )


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of at most max_bytes of text; a longer single text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins (one more than rows). Null is empty."""
    array = array.fill_null("") if array.null_count else array
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    array = array.cast(pa.string()) if not pa.types.is_string(array.type) else array
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def binaries(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column without nulls, and where each begins (one more than rows)."""
    array = array.cast(pa.binary()) if not pa.types.is_binary(array.type) else array
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def longs(array: pa.Array) -> np.ndarray:
    return array.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 2**64)
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class RollingHash:
    """Hashes of any spans of some bytes: a polynomial modulo 2**64 over random byte values, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.prefix = np.zeros(len(data) + 1, U64)
        values = BYTE_VALUES[data]
        values *= powers(BASE, len(data))
        np.cumsum(values, out=self.prefix[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.inverse[start]


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all words (runs without white space, never across texts); where each text's words begin."""
    inside = ~WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    stops = np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, offsets)
