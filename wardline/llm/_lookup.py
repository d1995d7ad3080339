"""Values of 64-bit keys in sorted hash arrays, and the way to give them to documents without a broadcast.

Documents are dealt to chunks of a bounded size. A chunk asks for its distinct keys, packed in order, bucket by bucket of the
hash range; a bucket holds its part of the table and answers with values in the same order, so that no key is sent back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import slices

_HALF = np.uint64(32)


class HashArrays(NamedTuple):
    """Sorted keys with their values; heads[h] is the first place whose key's upper bits reach h."""

    keys: np.ndarray
    values: np.ndarray
    heads: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> HashArrays:
        """keys: unsigned, spread evenly over 64 bits, in any order; of equal ones the first counts."""
        keys, first = np.unique(keys, return_index=True)
        bits = min(30, max(1, len(keys).bit_length() + 1))
        shift = np.uint64(64 - bits)
        heads = np.searchsorted(keys >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return HashArrays(keys, values[first], heads, shift)

    def get(self, wanted: np.ndarray, missing: float = 0.0) -> np.ndarray:
        out = np.full(len(wanted), missing, self.values.dtype)
        if not len(self.keys):
            return out
        upper = (wanted >> self.shift).astype(np.int64)
        at, stop = self.heads[upper], self.heads[upper + 1]
        open_ = np.flatnonzero(at < stop)
        at, stop, key = at[open_], stop[open_], wanted[open_]
        while len(open_):  # as often as the fullest of the ranges has keys
            hit = self.keys[at] == key
            out[open_[hit]] = self.values[at[hit]]
            left = ~hit & (at + 1 < stop)
            open_, at, stop, key = open_[left], at[left] + 1, stop[left], key[left]
        return out


def bucket_of(key: Column, buckets: int) -> Column:
    """The part of the unsigned key range, of `buckets` equal ones, in which a signed 64-bit key falls."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(buckets), 32).cast("int")


def deal(rows: DataFrame, chunk_chars: int) -> tuple[DataFrame, int]:
    """rows (doc_id, text, ...) with their chunk, dealt out once, and the number of chunks. Rows without an id are spread by their text."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks = max(1, -(-chars // chunk_chars))
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.length("text")), F.lit(chunks)).cast("int")
    return rows.withColumn("chunk", chunk).repartition(F.col("chunk")), chunks


def parts_of(chunk: pa.Table, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    for batch in chunk.combine_chunks().to_batches():
        yield from slices(batch, most=most)


Keys = Callable[[pa.RecordBatch], np.ndarray]


def chunk_keys(chunk: pa.Table, keys_of: Keys) -> np.ndarray:
    """The distinct keys of a chunk, in order."""
    got = [np.zeros(0, np.uint64)]
    for part in parts_of(chunk):
        got.append(np.unique(keys_of(part)))
        if len(got) > 8:
            got = [np.unique(np.concatenate(got))]
    return np.unique(np.concatenate(got))


def answers(dealt: DataFrame, keys_of: Keys, table: DataFrame, buckets: int, missing: float = 0.0) -> DataFrame:
    """chunk, bucket, found: for each chunk the values of its keys in a bucket, in the order of the keys. table: key, value (a double)."""

    def ask(key: tuple, chunk: pa.Table) -> pa.Table:
        keys = chunk_keys(chunk, keys_of)
        bucket = ((keys >> _HALF) * np.uint64(buckets) >> _HALF).astype(np.int32)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*heads[1:].tolist(), len(keys)]
        blobs = pa.array([keys[a:b].tobytes() for a, b in zip(heads.tolist(), ends, strict=False)], pa.binary())
        return pa.table([pa.array(np.full(len(heads), key[0].as_py(), np.int32)), pa.array(bucket[heads]), blobs], names=["chunk", "bucket", "keys"])

    def answer(key: tuple, asked: pa.Table, own: pa.Table) -> pa.Table:
        known = HashArrays.of(own.column("key").to_numpy().view(np.uint64), own.column("value").to_numpy())
        found = [known.get(np.frombuffer(x, np.uint64), missing).tobytes() for x in asked.column("keys").to_pylist()]
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(found, pa.binary())], names=["chunk", "bucket", "found"])

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, keys binary")
    placed = table.select(bucket_of(F.col("key"), buckets).alias("bucket"), "key", "value")
    return asked.groupBy("bucket").cogroup(placed.groupBy("bucket")).applyInArrow(answer, "chunk int, bucket int, found binary")


def received(chunk: pa.Table, keys_of: Keys, given: pa.Table) -> HashArrays:
    """The chunk's own table out of what the buckets gave it."""
    keys = chunk_keys(chunk, keys_of)
    blobs = [b for _, b in sorted(zip(given.column("bucket").to_pylist(), given.column("found").to_pylist(), strict=True))]
    return HashArrays.of(keys, np.frombuffer(b"".join(blobs), np.float64))


class Tally:
    """Sums by key. It is to be emptied when `full`, so that a task holds about `most` keys, whatever its input."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.parts, self.size = most, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > self.most:
            self.parts = [self._sums()]
            self.size = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.size > self.most // 2 and len(self.parts) == 1

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in self.parts)]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([np.zeros(0), *(n for _, n in self.parts)]), len(keys)).astype(np.int64)

    def empty(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = self._sums()
        self.parts, self.size = [], 0
        return keys, n
