"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; long texts make larger batches dangerous.
ARROW_ROWS = 500
#: Characters of text that an operator works on at once.
BATCH_CHARS = 6_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local
    master (tests) gets a temporary folder and any other an error: executors don't see one another's disks."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(shared_dir, "own", None)
        if not path:
            path = shared_dir.own = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the time of a block."""
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: lineage is cut and lost executors cost nothing.
    The shuffle files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once no later plan reads them."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds; every operator with a Python stage calls this."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker process holds from batch to batch, by the kind of work that fills it.
CACHES: dict[str, dict] = {}


def released() -> None:
    """Gives freed memory back to the system: a worker waits beside the JVM and the other workers of its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def only(*kinds: str) -> None:
    """Empties the worker's caches of other kinds: it outlives the operators that filled them."""
    gone = [c for kind, c in CACHES.items() if c and kind not in kinds]
    for c in gone:
        c.clear()
    if gone:
        released()


def trimmed(batches: Iterator) -> Iterator:
    """The same batches; what they left is released after the last."""
    yield from batches
    released()


def rebatched(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BATCH_CHARS) -> Iterator[pa.Table]:
    """Joins small batches until about `size` bytes of `column` are there. After the last, freed memory is released."""
    held, have = [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        have += b.column(b.schema.get_field_index(column)).nbytes
        if have >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, have = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
    held = []
    released()


def texts(t: pa.Table, column: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return ["" if x is None else x for x in t.column(column).to_pylist()]


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def ordered_bounds(df: DataFrame, key: str, n: int) -> tuple[np.ndarray, int]:
    """Quantiles of one column over all rows, which cut it into ordered buckets, and the number of buckets for rows
    without it: none, or as many as for the others."""
    quantiles = F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)
    row = df.agg(quantiles.alias("q"), (F.count("*") > F.count(key)).alias("some")).first()
    bounds = np.unique(np.array(row["q"] or [], dtype=np.int64))
    return bounds, len(bounds) + 1 if row["some"] else 0


def bucket_of(bounds: np.ndarray, keys: pa.Array) -> np.ndarray:
    """The bucket (0 .. len(bounds)) of each key; any for nulls."""
    return np.searchsorted(bounds, np.asarray(keys.fill_null(0), dtype=np.int64), side="left").astype(np.int32)


def dealt_in_order(df: DataFrame, key: str, n: int, as_name: str) -> tuple[DataFrame, int, int]:
    """Adds the ordered bucket of `key`; the numbers of buckets with and without it."""
    bounds, nameless = ordered_bounds(df, key, n)

    @F.arrow_udf("int")
    def bucket(x: pa.Array) -> pa.Array:
        return pa.array(bucket_of(bounds, x))

    return df.withColumn(as_name, bucket(F.col(key))), len(bounds) + 1, nameless


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads their bits."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64, copy=False) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * M1
        z = (z ^ (z >> np.uint64(27))) * M2
        return z ^ (z >> np.uint64(31))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
