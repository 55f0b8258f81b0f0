"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once: bounds a batch of long texts. Set where the session has the default of 10,000.
ARROW_ROWS = "500"
#: Rows of ids alone (16 bytes or so) that may be broadcast; they are counted first.
MOST_BROADCAST = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; also bounds the rows of an Arrow batch for this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session without other machines (tests)
    gets a new folder; on a cluster that would be one of the driver's own, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_made: list[list[str]] = []


@contextlib.contextmanager
def intermediate(spark: SparkSession) -> Iterator[list[str]]:
    """Removes the tables stored within, but for those whose paths are taken off the list."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        for path in _made.pop():
            remove(spark, path)


def scratch(spark: SparkSession) -> str:
    """A path for a table in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/lodestrata/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    if _made:
        _made[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and survives lost executors. Once the table is
    written, the shuffle files that made it are of no use, and Spark is asked to remove them."""
    spark = df.sparkSession
    path = scratch(spark)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._lodestrata_path = path
    return back


#: Columns of documents that operators work on.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def fenced(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that returns the columns of its documents: all others than OWN bear names of no helper column within."""

    @functools.wraps(stage)
    def run(docs: DataFrame, *args, **settings) -> DataFrame:
        quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
        inner = {c: c if c in OWN else f"extra_{i}" for i, c in enumerate(docs.columns)}
        out = stage(docs.select(*[quoted(c).alias(x) for c, x in inner.items()]), *args, **settings)
        return out.select(*[F.col(x).alias(c) for c, x in inner.items()])

    return run


def discard(*frames: DataFrame) -> None:
    """Removes the files of stored() tables that are no longer read."""
    for df in frames:
        if path := getattr(df, "_lodestrata_path", None):
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of DataFrames that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fan_out(df: DataFrame, n: int = 3) -> int:
    """Partitions for a shuffle whose rows are large blobs: the session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def remainder(column: str, mod: int) -> F.Column:
    """crc32 of a column as text, modulo mod. A null id counts as remainder -1, so it is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(-1))


def binary(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def flat_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: (row starts, indices into the vocabulary, vocabulary).

    Words are runs without ASCII white space; A-Z is lower-cased. A null text has no words.
    """
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        flat, starts = flat.filter(pa.array(full)), kept[starts]
    words = flat.dictionary_encode()
    return starts, words.indices.to_numpy().astype(np.int64), words.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in values.to_pylist()), np.uint64, len(values))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the murmur3 one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gathered(batches: Iterator[pa.RecordBatch], column: str, least_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their text has about least_bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= least_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size or held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece's text has about most_bytes at most (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            # a copy: string kernels of pyarrow misread some arrays with an offset
            yield batch if (start, stop) == (0, batch.num_rows) else batch.take(pa.array(np.arange(start, stop)))
            start = stop
    trim()


def trim() -> None:
    """Gives memory that is no longer used back to the system: Python workers live on for later stages."""
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
