"""Pieces that several operators share: inputs, shared scratch tables, salted joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after every real id; stands for a null doc_id inside the operators.
NO_ID = (1 << 63) - 1
#: Copies of the small side in a salted join; a hot key is spread over as many tasks.
SALTS = 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, one of our own, but only if all of Spark is on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def settle(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_transfers(spark: SparkSession, limit: int = 4 << 20):
    """While tables are settled inside, Arrow batches to Python end at about ``limit`` bytes, whatever their rows; the setting is put back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release(spark: SparkSession) -> None:
    """Have Spark drop shuffle files that nothing refers to any more: it does so when the driver collects its garbage.

    The first collection frees what held them, the second them.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def corpus_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, counted over every row."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(column))), F.lit(0)).alias("b")).first()["b"])


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salt_by: Column | None = None, salts: int = SALTS, merge: bool = False) -> DataFrame:
    """Join many rows to a table with one row a key, with a hot key's rows dealt over several tasks.

    ``small`` is repeated ``salts`` times, so it should be the smaller side by that factor.
    With ``merge`` it's sorted and merged whatever its size, and never held by every executor.
    """
    salt = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge") if merge else right, [*keys, "_salt"], how).drop("_salt")


def train_fold(doc_id: Column) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array, and the offsets of each row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        return bytes_of(pa.array([x or b"" for x in column.to_pylist()], pa.large_binary())) if int(lengths.sum()) != int(offsets[-1] - offsets[0]) else _cut(column, offsets)
    return _cut(column, offsets)


def _cut(column: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


_tables: dict[str, object] = {}
_owner = ""


def keeps(owner: str, clear) -> None:
    """``owner`` keeps tables in a worker between tasks; ``clear`` drops them."""
    _tables[owner] = clear


def only(owner: str) -> None:
    """A worker keeps the tables of one operator at a time: the others' go when this one's task begins.

    What the worker's last task has freed goes back to the system too.
    """
    global _owner
    if owner != _owner:
        for k, clear in _tables.items():
            if k != owner:
                clear()
        if _owner in _tables:
            gc.collect()
        _owner = owner
    trim()


def trim() -> None:
    """Freed memory goes back to the system; a worker that waits for a task should hold little."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library keeps what it keeps
    _libc = None


def small_batches(rows, most: int = 1000):
    """Arrow batches of at most ``most`` rows, so that what a batch becomes in Python stays small."""
    for b in rows:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
    trim()


def sliced(rows, column: str, limit: int):
    """Arrow batches cut and joined into tables of about ``limit`` bytes of text; a longer text is a table of its own."""
    held, size = [], 0
    for b in rows:
        lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column)).cast(pa.large_binary())), 0))
        ends = np.cumsum(lengths)
        start = 0
        while start < b.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit - size, "right")))
            stop = min(stop, b.num_rows)
            held.append(b.slice(start, stop - start))
            size += int(ends[stop - 1]) - done
            start = stop
            if size >= limit or start < b.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: How many times the rows wanted may pass ``first_by_hash`` before the sort.
SPARE = 2


def first_by_hash(rows: DataFrame, key: str, many: int, count: int) -> DataFrame:
    """The first ``many`` of ``count`` rows in order of the hash of ``key``, then ``key``.

    A sort with a limit passes on as many rows from every task. So rows whose
    hash is beyond some ``SPARE`` times the share wanted are left out before it;
    of keys that differ more than enough remain. Where copies of few keys make up
    most rows, fewer than ``many`` can come.
    """
    share = min(1.0, SPARE * many / max(1, count))
    place = F.xxhash64(F.col(key))
    near = place <= min(2**63 - 1, int(share * 2**64) - 2**63)
    return rows.where(near).orderBy(place, key).limit(many)
