"""Shared plumbing of the training-data operators: input shaping, staging, word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that end a word, as a Java regex class body.
WORD_SPACES = r"\x20\x09-\x0D"


def pick(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: extra columns of ``docs`` can't clash with ours."""
    return docs.select(*[docs[src].alias(dst) for dst, src in columns.items()])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, as in tests, one below the warehouse, which on a
    cluster must then be a folder that driver and executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_attesta_staging"
    return folder.rstrip("/")


#: Paths staged so far, in order.
_STAGED: list[str] = []


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This freezes values that depend on how rows were dealt out (partition numbers, range bounds) and cuts
    lineage; a lost executor costs only a re-read. What is staged stays, as results may read it later; see ``scratch``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attesta/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end what is staged inside, but for tables staged by the function it gives."""
    before, kept = len(_STAGED), set()

    def keep(df: DataFrame, what: str) -> DataFrame:
        out = staged(df, what)
        kept.add(_STAGED[-1])
        return out

    try:
        yield keep
    finally:
        made, _STAGED[before:] = _STAGED[before:], []
        _STAGED.extend(p for p in made if p in kept)
        delete(spark, [p for p in made if p not in kept])


def last_staged() -> list[str]:
    """The path of the table staged last, as a list."""
    return _STAGED[-1:]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged tables, wherever the shared folder is."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives memory that a finished task no longer needs back to the system, as Spark keeps its workers for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256 of the text; an empty binary for null."""
    return F.when(text.isNull(), F.unhex(F.lit(""))).otherwise(F.substring(F.unhex(F.sha2(text, 256)), 1, 16))


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes (or None) of each string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64 on unsigned 64-bit lanes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all windows of a fixed number of words from prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.up = np.cumprod(np.full(n, self.base, np.uint64)) * np.uint64(self.inverse)
        self.down = np.cumprod(np.full(n, self.inverse, np.uint64)) * np.uint64(self.base)

    def windows(self, hashes: np.ndarray, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the window that starts at each position (or at those of ``at``)."""
        n = len(hashes)
        if n < length:
            return np.empty(0, np.uint64)
        if n > len(self.up):
            self._grow(2 * n)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        if at is None:
            return mix((sums[length:] - sums[: n - length + 1]) * self.down[: n - length + 1])
        return mix((sums[at + length] - sums[at]) * self.down[at])


def binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values: consecutive slices of ``data`` between ``bounds`` (in items)."""
    data = np.ascontiguousarray(data)
    offsets = (np.asarray(bounds, np.int64) * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _murmur3_int(value: int, seed: int = 42) -> int:
    """Spark's hash of an int column, as a signed 32-bit number."""
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    k = rot(value * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
    h = (rot(seed ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 4
    h = (h ^ (h >> 16)) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def one_part_each(n: int) -> np.ndarray:
    """``n`` ints of which ``repartition(n, column)`` puts each in a partition of its own."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < n:
        found.setdefault(_murmur3_int(value) % n, value)
        value += 1
    return np.array([found[p] for p in range(n)], np.int32)
