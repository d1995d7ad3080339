"""Periodic runs of words by a dictionary of basic factors.

Level k of the dictionary names every factor of 2^k words that comes twice or more in its document; a factor of the next level is
a pair of names. A factor's successor is its next occurrence. Where a factor and its successor have successors at the same distance,
of at most twice their length, the three occurrences are an arithmetic progression and propose that distance as a period. A run of
period q and at least 4 * q words holds such a progression of distance q at the first level whose factors have q words or more, and
there no nearer occurrence, since a run's smallest period is primitive. Proposals are extended to both sides with the dictionary's
names, longest factors first, which finds a run's ends in a logarithmic number of steps; equal runs are one.

A document is worked on in one task, with no other table: a run lies in one document. A batch of documents shares one dictionary,
whose names never cross a document. Memory is about 8 bytes for each level and each word whose factor repeats.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import mix, slices, texts, words

#: A run has at least LEAST words and EXPONENT times its period.
LEAST = 6
EXPONENT = 4
#: Documents of a batch are handled together up to this number of bytes.
BATCH_BYTES = 4 << 20
RUNS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Level(NamedTuple):
    """Places of repeated factors of one length, in order, and their names."""

    at: np.ndarray
    name: np.ndarray

    def names(self, place: np.ndarray) -> np.ndarray:
        """Names at these places; -1 where the factor does not repeat."""
        k = np.minimum(np.searchsorted(self.at, place), max(len(self.at) - 1, 0))
        return np.where(self.at[k] == place, self.name[k], -1) if len(self.at) else np.full(len(place), -1, np.int32)


def repeated(at: np.ndarray, key: np.ndarray) -> tuple[Level, np.ndarray]:
    """The level of the places whose key comes again, and each one's distance to the next with its key (0: none)."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    again = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    name = np.cumsum(np.concatenate([[0], ~same])) if len(key) else np.zeros(0, np.int64)
    gap = np.zeros(len(key), np.int64)
    gap[:-1][same] = np.diff(at[order])[same]
    back = np.empty(len(key), np.int64)
    back[order] = np.arange(len(key))
    keep = again[back]
    return Level(at[keep].astype(np.int32), name[back][keep].astype(np.int32)), gap[back][keep]


def progressions(level: Level, gap: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the first of neighbouring places where three occurrences stand at one distance of at most `most`."""
    first = np.flatnonzero((gap > 0) & (gap <= most))
    after = np.searchsorted(level.at, level.at[first] + gap[first])
    first = first[gap[after] == gap[first]]
    place, distance = level.at[first].astype(np.int64), gap[first]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (distance[1:] != distance[:-1])
    return place[new], distance[new]


def reach(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many words are the same from a and b on (or before them)."""
    got = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    top = len(levels) - 1
    for k in range(top, -1, -1):
        lanes = open_ if k == top else np.arange(len(a))
        while len(lanes):
            step = got[lanes] if forward else -got[lanes] - (1 << k)
            left, right = a[lanes] + step, b[lanes] + step
            same = levels[k].names(left)
            lanes = lanes[(same >= 0) & (same == levels[k].names(right))]
            got[lanes] += 1 << k
            if k < top:  # below the top each length is taken at most once
                break
    return got


def find_runs(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all runs, by start and period. codes: words of documents first[i]:first[i + 1]."""
    if not len(codes):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    row = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    level, gap = repeated(np.arange(len(codes)), mix(codes + mix(row * np.uint64(2) + np.uint64(1))))
    levels, places, periods = [], [], []
    longest = int(np.diff(first).max())
    k = 0
    while len(level.at):
        levels.append(level)
        place, distance = progressions(level, gap, 2 << k)
        places.append(place)
        periods.append(distance)
        if 1 << k >= longest // EXPONENT:  # no run's period is longer than these factors
            break
        follows = level.names(level.at + (1 << k))
        pair = follows >= 0
        key = level.name[pair].astype(np.int64) << 32 | follows[pair]
        level, gap = repeated(level.at[pair].astype(np.int64), key)
        k += 1
    place, period = np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *periods])
    if not len(place):
        return place, place, place
    after = reach(levels, place, place + period, True)
    before = reach(levels, place, place + period, False)
    start, length = place - before, before + after + period
    long = (length >= LEAST) & (length >= EXPONENT * period)
    found = np.unique(np.stack([start[long], period[long], length[long]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def repetition(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the query's rule makes a tenth of the documents periodic, and with which period. A null id is never chosen."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_runs, the run of greatest exponent, and digests of all runs and of the words left.

    A run is a stretch of words of smallest period q, of at least max(6, 4 * q) words, that cannot be extended; words are compared by
    64-bit hashes. Of a run all words after its first q are dropped. With `planted` the text is first changed by the query's rule.
    Null, empty and wordless texts have no run, four nulls and the digests of nothing; ties go to the smallest start, then period;
    rows that repeat an id, or have none, are judged each by its own text; an empty table gives no rows; other columns are ignored.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=BATCH_BYTES):
                yield _judge(part, planted)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, RUNS)


def _judge(part: pa.RecordBatch, planted: bool) -> pa.RecordBatch:
    t = texts(part.column("text"))
    w = words(t)
    codes, source = w.hash, np.arange(len(w.hash))
    ids = part.column("doc_id").to_pylist()
    for row, doc in enumerate(ids if planted else []):
        begin, n = int(w.first[row]), int(w.first[row + 1] - w.first[row])
        if rule := repetition(doc, n):
            a, p = rule
            source[begin + a : begin + n] = begin + a + np.arange(n - a) % p
    codes = codes[source]
    start, length, period = find_runs(codes, w.first)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    bounds = np.searchsorted(start, w.first)
    data, rows = t.data.tobytes(), []
    for row, doc in enumerate(ids):
        lo, hi = int(w.first[row]), int(w.first[row + 1])
        own = data[t.offsets[row] : t.offsets[row + 1]].split()
        left = [own[k] for k in (source[lo:hi][kept[lo:hi]] - lo).tolist()]
        runs = [*zip(*(x[bounds[row] : bounds[row + 1]].tolist() for x in (start, length, period)), strict=True)]
        listed = [(s - lo, n, q) for s, n, q in runs]
        best = None
        for run in listed:  # by start, then period
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in listed).encode()).hexdigest()
        rows.append((doc, hi - lo, len(listed), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest, hashlib.sha256(b" ".join(left)).hexdigest()))
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
