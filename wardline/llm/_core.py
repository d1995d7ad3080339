"""Vectorised text handling shared by the corpus operators.

Tasks receive Arrow batches; these helpers work on the UTF-8 buffers of a text column directly, so no Python string is
made per word. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A slice's arrays take some forty times its bytes.
SLICE_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)
_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_GRAM_KEY = _rng.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)

#: ASCII white space, the separators of `[^\x20\x09-\x0D]+`.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: What is not in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x30:0x3A] = NON_ALNUM[0x61:0x7B] = NON_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own where none is set, in local mode only."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not got and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        sc.setCheckpointDir(got or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


_MADE: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table written to the shared folder, so that a lost executor costs no recomputation."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables that no later step reads."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        home = spark._jvm.org.apache.hadoop.fs.Path(path)
        home.getFileSystem(conf).delete(home, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators make inside are removed at its end; by then their result has to be written."""
    before = len(_MADE)
    yield
    discard(spark, _MADE[before:])
    del _MADE[before:]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Texts(NamedTuple):
    """Concatenated UTF-8 bytes of some rows; row i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


def texts(column: pa.Array) -> Texts:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(column) else np.zeros(0, np.uint8)
    return Texts(data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64))


BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Arrow batches of at most `most` bytes from here on in this session: both sides of a task hold a batch's buffers several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def give_back() -> None:
    """Frees what a worker's allocators hold and don't use: workers serve many stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):  # glibc only
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about `most` bytes of text; a longer single text is a slice of its own."""
    offsets = texts(batch.column(column)).offsets
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop
    give_back()


class Words(NamedTuple):
    """Words in row order: byte bounds, 64-bit hashes, and first[i]:first[i + 1] are the words of row i."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(t: Texts, separators: np.ndarray = SPACES, hashed: bool = True) -> Words:
    """Maximal runs of bytes that are no separators; a row's end ends a word."""
    n = len(t.data)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(0, np.uint64), np.zeros(len(t.offsets), np.int64))
    inside = ~separators[t.data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[t.offsets[:-1][t.offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[t.offsets[1:][t.offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, t.offsets)
    return Words(start, end, run_hash(t.data, start, end) if hashed else np.zeros(0, np.uint64), first)


def run_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start[i]:end[i]], which must be sorted and disjoint."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    power = np.cumprod(np.full(int(length.max()) + 1, _BASE))
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTE_KEY[data[np.repeat(start, length) + at]] * power[at]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64))


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one row, and the word at which each starts."""
    total = len(w.start)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        h += (w.hash[k : total - n + 1 + k] ^ (w.hash[k : total - n + 1 + k] >> _U(29))) * _GRAM_KEY[k]
    last = np.repeat(w.first[1:], np.diff(w.first))  # where each word's row ends
    at = np.flatnonzero(np.arange(total - n + 1) + n <= last[: total - n + 1])
    return mix(h[at]), at


def covered(total: int, start: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words in start[i]:start[i] + n."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n, total), -1)
    return np.cumsum(edge[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of flags[first[i]:first[i + 1]] for each i."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[first[1:]] - total[first[:-1]]


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


#: Keys with a share of 1 / HOT of all rows or more are looked up under SPREAD keys each.
HOT, SPREAD = 10_000, 64


def looked_up(rows: DataFrame, table: DataFrame, key: list[str], spread_by: str, copies: str) -> DataFrame:
    """rows joined to table on key; table has one row a key, and in `copies` how many of rows it stands for.

    At most HOT keys stand for such a share that their rows meet the table under SPREAD keys each, dealt by spread_by; that list is broadcast.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    keys, salt = unused(rows, "spread"), unused(rows, "salt")
    hot = F.broadcast(table.where(F.col(copies) > max(1, total // HOT)).select(*key, F.lit(SPREAD).alias(keys)))
    dealt = rows.join(hot, key, "left").withColumn(salt, F.pmod(F.xxhash64(spread_by), F.coalesce(keys, F.lit(1))).cast("int")).drop(keys)
    held = table.drop(copies).join(hot, key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(keys) - 1, F.lit(0))))).drop(keys)
    return dealt.join(held, [*key, salt]).drop(salt)


#: 64 symbols of bytes: a-z 1-26 (A-Z alike), digits 27, full stop 28, comma 29, other ASCII 30, UTF-8 continuation bytes 31-54,
#: lead bytes 55-62, white space 0.
SYMBOL = np.full(256, 30, np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(1, 27)
SYMBOL[48:58], SYMBOL[46], SYMBOL[44] = 27, 28, 29
SYMBOL[0x80:0xC0] = 31 + np.arange(64) % 24
SYMBOL[0xC0:] = 55 + np.arange(64) % 8
SYMBOL[SPACES] = 0


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)
