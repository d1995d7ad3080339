"""Spelling variants by search schemes over a bidirectional FM-index.

The vocabulary is counted by Spark. Two words at one inserted, deleted or replaced code point share the half of either one that
the error does not fall in. So a word goes to the shard of its first three code points and to that of its last three (a half has three at
least), and a shard has a bidirectional FM-index over its words, each behind a delimiter. A search starts between the halves, extends over one half
to its delimiter exactly, turns, and extends over the other half to the other delimiter, allowing one error. Both directions' suffix-rank
intervals are kept in step. What both shards would find is given by the first only, so shards return sums and best words for each
word, never pairs.

A shard holds about BLOCK words. The words of a key with more are dealt to several indexes, and each asks all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, Texts, materialize, run_hash, slices, texts
from .substring_dedup import BitVector

#: Words are those of LEAST code points and COUNT occurrences or more; a form has RATIO times the occurrences.
LEAST, COUNT, RATIO = 6, 5, 5
KEY = 3
BLOCK = 1 << 14
QUERIES = 1 << 11
#: The query's rule deletes a code point of the runs whose checksum this number divides.
RULE = 199
#: Texts whose words are counted together.
COUNT_BYTES = 4 << 20
#: Runs of more bytes are summed one by one.
SHORT = 64
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8

#: a-z are 1 to 26, U+00C0 to U+00FF 27 to 90; 0 delimits.
DEPTH = 7
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0xC0:] = np.arange(27, 91)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def letter_runs(t: Texts, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds, code points and row of the maximal runs of `[A-Za-z\\u00C0-\\u00FF]` of at least so many code points."""
    n = len(t.data)
    zero = np.zeros(0, np.int64)
    if not n:
        return zero, zero, zero, zero
    low = LOWER[t.data]
    lead = t.data == _LEAD
    inside = (low >= 97) & (low <= 122) | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = end - start - (leads[end] - leads[start])
    long = points >= least
    start, end, points = start[long], end[long], points[long]
    return start, end, points, np.searchsorted(t.offsets, start, "right") - 1


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end], begun at the sum `seed` of what stands before it."""
    out = np.empty(len(start), np.uint32)
    size = end - start
    order = np.argsort(-size, kind="stable")
    far = int(np.count_nonzero(size > SHORT))
    for k in order[:far].tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(seed[k]))
    order = order[far:]
    size, at = size[order], start[order]
    state = ~seed[order].astype(np.uint32)
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))  # those of more than j bytes
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    out[order] = ~state
    return out


def word_counts(docs: DataFrame, altered: bool = False) -> DataFrame:
    """word, n of the lower-cased runs of at least LEAST code points; `altered` first applies the query's rule, which spares null ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=COUNT_BYTES):
                yield _count(part, altered)

    return docs.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _count(part: pa.RecordBatch, altered: bool) -> pa.RecordBatch:
    t = texts(part.column("text"))
    start, end, _, row = letter_runs(t)
    data = LOWER[t.data]
    words, n = [], []
    if altered and len(start):
        ids = part.column("doc_id").to_pylist()
        seed = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], np.uint32)
        sums = checksums(data, start, end, seed[row])
        hit = (sums % RULE == 0) & np.array([d is not None for d in ids])[row]
        for k in np.flatnonzero(hit).tolist():
            run = data[start[k] : end[k]].tobytes().decode()
            at = int(sums[k]) % len(run)
            if len(run) > LEAST:
                words.append(run[:at] + run[at + 1 :])
                n.append(1)
        start, end = start[~hit], end[~hit]
    _, one, times = np.unique(run_hash(data, start, end), return_index=True, return_counts=True)
    start, size = start[one], end[one] - start[one]
    stops = np.cumsum(size)
    flat = data[np.repeat(start - stops + size, size) + np.arange(int(size.sum()))]
    bounds = pa.py_buffer(np.concatenate([[0], stops]).astype(np.int32))
    known = pa.StringArray.from_buffers(len(one), bounds, pa.py_buffer(flat))
    return pa.RecordBatch.from_arrays([pa.concat_arrays([known, pa.array(words, pa.string())]), pa.array(np.concatenate([times, np.array(n, np.int64)]))], names=["word", "n"])


class Direction:
    """One of the two transforms of a circular text, as a wavelet matrix."""

    def __init__(self, text: np.ndarray) -> None:
        n = len(text)
        rank = np.zeros(n, np.int64)
        for k in range(8):
            rank = rank << DEPTH | np.roll(text, -k)
        rank, span = np.unique(rank, return_inverse=True)[1], 8
        while rank.max() + 1 < n:
            rank = np.unique(rank * n + np.roll(rank, -(span % n)), return_inverse=True)[1]
            span *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        transform = text[self.order - 1]
        self.first = np.searchsorted(text[self.order], np.arange(1 << DEPTH))
        self.levels: list[BitVector] = []
        for level in range(DEPTH - 1, -1, -1):
            bit = transform >> level & 1 == 1
            self.levels.append(BitVector.of(bit))
            transform = np.concatenate([transform[~bit], transform[bit]])
        symbols = np.arange(1 << DEPTH)
        self.base = self._walk(symbols, np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64))[0]

    def _walk(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        smaller = np.zeros(len(low), np.int64)
        for k, level in enumerate(self.levels):
            one = symbol >> (DEPTH - 1 - k) & 1 == 1
            a, b = level.rank(low), level.rank(high)
            smaller += np.where(one, high - b - low + a, 0)
            low, high = np.where(one, level.zeros + a, low - a), np.where(one, level.zeros + b, high - b)
        return low, high, smaller

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval after one more symbol, and how many rows of the old one have a smaller symbol there."""
        a, b, smaller = self._walk(symbol, low, high)
        shift = self.first[symbol] - self.base[symbol]
        return a + shift, b + shift, smaller

    def every(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All symbols that extend the intervals: index of the interval, symbol, new interval."""
        of, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level in self.levels:
            a, b = level.rank(low), level.rank(high)
            zero, one = high - b > low - a, b > a
            of = np.concatenate([of[zero], of[one]])
            symbol = np.concatenate([symbol[zero] << 1, symbol[one] << 1 | 1])
            low, high = np.concatenate([(low - a)[zero], (level.zeros + a)[one]]), np.concatenate([(high - b)[zero], (level.zeros + b)[one]])
        shift = self.first[symbol] - self.base[symbol]
        return of, symbol, low + shift, high + shift


class Words:
    """Words as symbols: word i is flat[start[i]:start[i] + size[i]]."""

    def __init__(self, raw: list[bytes]) -> None:
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.append(_SYMBOL[np.frombuffer(b"".join(raw), np.uint8)], 0)

    def symbol(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The symbol at a place of a word, the delimiter behind its end."""
        return np.where(at < self.size[word], self.flat[np.minimum(self.start[word] + at, len(self.flat) - 1)], 0)


class BidirectionalIndex:
    """Over words that differ from each other, a delimiter before each, read as a circle."""

    def __init__(self, words: Words) -> None:
        n = len(words.size)
        heads = np.cumsum(words.size + 1) - words.size - 1
        text = np.zeros(int(words.size.sum()) + n, np.int64)
        inside = np.ones(len(text), bool)
        inside[heads] = False
        text[inside] = words.flat[:-1]
        self.total = len(text)
        self.left, self.right = Direction(text), Direction(text[::-1])
        self.word = np.zeros(self.total, np.int64)  # the word before each delimiter
        self.word[heads] = np.arange(n) - 1
        self.word[0] = n - 1

    def near(self, words: Words, asked: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (asked word, indexed word) at one error behind the first `exact` symbols, which are the same."""
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), self.total)
        mirror = low.copy()
        for j in range(int(exact.max(initial=0)) + 1):  # leftwards from the split, and over the delimiter
            lanes = np.flatnonzero((j <= exact) & (high > low))
            own = asked[lanes]
            symbol = np.where(j < exact[lanes], words.flat[words.start[own] + np.maximum(exact[lanes] - 1 - j, 0)], 0)
            low[lanes], high[lanes], smaller = self.left.extend(symbol, low[lanes], high[lanes])
            mirror[lanes] += smaller
        # The turn: from here on the mirrored intervals are extended to the right.
        live = high > low
        of, at, low, high = asked[live], exact[live], mirror[live], (mirror + high - low)[live]
        opened = []
        while len(of):
            wanted = words.symbol(of, at)
            inner = at < words.size[of]
            cut = inner & (words.symbol(of, at + 1) != wanted)  # of equal neighbours the last is deleted
            opened.append((of[cut], at[cut] + 1, low[cut], high[cut]))
            k, symbol, a, b = self.right.every(low, high)
            same = symbol == wanted[k]
            other = ~same & (symbol > 0)
            opened.append((of[k[other]], at[k[other]], a[other], b[other]))
            swap = other & inner[k]
            opened.append((of[k[swap]], at[k[swap]] + 1, a[swap], b[swap]))
            on = same & inner[k]
            of, at, low, high = of[k[on]], at[k[on]] + 1, a[on], b[on]
        if not opened:
            return of, of
        of, at, low, high = (np.concatenate(x) for x in zip(*opened, strict=True))
        asked_, found = [], []
        while len(of):
            symbol = words.symbol(of, at)
            low, high, _ = self.right.extend(symbol, low, high)
            live = high > low
            ended = live & (symbol == 0)
            asked_.append(of[ended])
            found.append(self.word[self.total - 1 - self.right.order[low[ended]]])
            on = live & (symbol > 0)
            of, at, low, high = of[on], at[on] + 1, low[on], high[on]
        return np.concatenate(asked_), np.concatenate(found)


def same_front(a: Words, i: np.ndarray, b: Words, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the first size symbols of words a[i] and b[j] are the same."""
    same = b.size[j] >= size
    open_ = np.flatnonzero(same)
    for k in range(int(size.max(initial=0))):
        open_ = open_[size[open_] > k]
        equal = a.flat[a.start[i[open_]] + k] == b.flat[b.start[j[open_]] + k]
        same[open_[~equal]] = False
        open_ = open_[equal]
    return same


NEAR = "word string, n_near long, best_n long, best string"


def search_shard(rows: pa.Table, side: int) -> pa.Table:
    """For each asked word of a shard its near words among the indexed: their number, and the most frequent one."""
    raw = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
    n = rows.column("n").to_numpy()
    indexed = np.flatnonzero(rows.column("indexed").to_numpy(zero_copy_only=False))
    forward = Words(raw)
    split = forward.size // 2
    # The second side is the first of the words read backwards.
    words = forward if side == 0 else Words([w[::-1] for w in raw])
    exact = split if side == 0 else forward.size - split
    index = BidirectionalIndex(Words([raw[k] if side == 0 else raw[k][::-1] for k in indexed.tolist()])) if len(indexed) else None
    kept = []
    for k in range(0, len(raw) if index else 0, QUERIES):
        asked = np.arange(k, min(k + QUERIES, len(raw)))
        x, y = index.near(words, asked, exact[asked])
        y = indexed[y]
        if side:
            new = ~same_front(forward, x, forward, y, split[x])
            x, y = x[new], y[new]
        kept.append((x, y))
    x, y = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in kept)]) for i in (0, 1))
    place = np.empty(len(raw), np.int64)
    place[sorted(range(len(raw)), key=raw.__getitem__)] = np.arange(len(raw))
    order = np.lexsort([place[y], -n[y], x])
    x, y = x[order], y[order]
    heads = np.flatnonzero(np.diff(x, prepend=-1))
    names = rows.column("word")
    times = np.diff(np.append(heads, len(x)))
    return pa.table([names.take(pa.array(x[heads])), pa.array(times), pa.array(n[y[heads]]), names.take(pa.array(y[heads]))], names=["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best: of the words that have a near one. vocabulary: distinct word, n; a table."""
    shards = max(1, -(-vocabulary.count() // block))
    ends = F.array(F.struct(F.lit(0).alias("side"), F.substring("word", 1, KEY).alias("key")), F.struct(F.lit(1).alias("side"), F.substring("word", -KEY, KEY).alias("key")))
    rows = vocabulary.select("word", "n", F.explode(ends).alias("end")).select("word", "n", "end.*")
    # At most two for each `block` words of the vocabulary.
    hot = rows.groupBy("side", "key").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > block).select("side", "key", F.ceil(F.col("words") / block).cast("int").alias("blocks"))
    placed = rows.join(F.broadcast(hot), ["side", "key"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    home = F.when(F.col("blocks").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string")).otherwise(F.col("key"))
    own = F.coalesce(F.pmod(F.xxhash64("word"), F.col("blocks")) == F.col("part"), F.lit(True))
    placed = placed.select("side", home.alias("home"), "part", "word", "n", own.alias("indexed"))

    def search(key: tuple, rows: pa.Table) -> pa.Table:
        return search_shard(rows, key[0].as_py())

    found = placed.groupBy("side", "home", "part").applyInArrow(search, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows word, form: each round doubles the way; forms grow in n by RATIO, so no way is a circle and all are short."""
    ways = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ways = further.drop("moved")
        if further.where("moved").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", altered: bool = False, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words of at least six code points and five occurrences.

    A word's form is its near word (one inserted, deleted or replaced code point) of largest n, the first in code-point order of equal ones, if it
    has five times the word's n. Null and empty texts hold no word; rows that repeat, or have no id, count as often as they come; a long text is counted in
    one task; an empty table gives no rows; other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = materialize(word_counts(rows, altered).where((F.col("n") >= COUNT) & (F.length("word") >= LEAST)))
    near = near_words(vocabulary, block)
    best = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    formed = materialize(
        vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), best["word"].alias("form"), (-best["less"]).alias("form_n"))
    )
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
