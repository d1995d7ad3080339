"""Substring deduplication with a compressed FM-index per shard.

A window is WINDOW consecutive words. Its anchor is the smallest hash of its word ANCHOR-grams; consecutive windows with one
anchor form a run. Equal windows have equal anchors, so a shard that holds all runs of some anchors can decide their windows
alone, and the work grows with the corpus, not with shards times corpus. Only runs whose anchor stands in words that another
document has beside it too are kept: documents are dealt to chunks of a bounded size, each chunk sends hashes of those words,
packed, to buckets, and gets one bit for each back.
Equal runs are combined map-side to the smallest document first; a shard indexes the distinct ones: suffixes sorted by their
first words, the Burrows-Wheeler transform in a wavelet matrix of bit vectors with block counts. The runs are then streamed
through a backward search that yields matching statistics, all runs in step; each interval at the threshold gives the smallest
document in which its window starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import Texts, Words, covered, grams, mix, per_row, slices, texts, words

WINDOW = 13
ANCHOR = 4
RUN_WINDOWS = 48
SHARD_WORDS = 1 << 16
#: The anchor and half of a window's other words, rounded up.
CONTEXT = ANCHOR + (WINDOW - ANCHOR + 1) // 2
CHUNK_CHARS = 4_000_000
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
RUNS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("chunk", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int32()), ("start", pa.int32())])


class BitVector(NamedTuple):
    """64-bit words of bits and the ones before each."""

    bits: np.ndarray
    before: np.ndarray
    zeros: int

    @staticmethod
    def of(flags: np.ndarray) -> BitVector:
        packed = np.packbits(flags, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32)
        return BitVector(packed, ones, len(flags) - int(ones[-1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.bits[word] & mask)


class FMIndex:
    """Backward search over the words of some runs; a suffix is sorted by its first 16 words, which is enough for patterns of WINDOW."""

    def __init__(self, hashes: np.ndarray, length: np.ndarray, owner: np.ndarray) -> None:
        self.names = np.unique(hashes)
        ends = np.cumsum(length + 1)
        n = int(ends[-1])
        text = np.zeros(n, np.int64)  # 0 ends each run
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = np.searchsorted(self.names, hashes) + 1
        rank = text
        for k in (1, 2, 4, 8):
            later = np.zeros(n, np.int64)
            later[:-k] = rank[k:] + 1 if n > k else 0
            rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.size = n
        self.first = np.searchsorted(text[order], np.arange(len(self.names) + 2))
        self.levels: list[BitVector] = []
        for level in range(int(len(self.names)).bit_length() - 1, -1, -1):
            bit = bwt >> level & 1 == 1
            self.levels.append(BitVector.of(bit))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])
        self.base = self._walk(np.arange(len(self.names) + 1), np.zeros(len(self.names) + 1, np.int64))
        padded = np.concatenate([text, np.zeros(WINDOW, np.int64)])
        lcp, alike = np.zeros(n, np.int64), np.ones(n, bool)
        alike[0] = False
        for k in range(WINDOW):
            alike[1:] &= padded[order[1:] + k] == padded[order[:-1] + k]
            lcp += alike
        at = np.arange(n)
        self.left = [np.zeros(n, np.int64)]
        self.right = [np.full(n, n)]
        for k in range(1, WINDOW + 1):
            heads = np.flatnonzero(lcp < k)
            self.left.append(np.maximum.accumulate(np.where(lcp < k, at, 0)))
            self.right.append(np.append(heads[1:], n)[np.searchsorted(heads, at, "right") - 1])
        heads = np.flatnonzero(lcp < WINDOW)
        least = np.minimum.reduceat(np.repeat(owner, length + 1)[order], heads)
        self.least = least[np.searchsorted(heads, at, "right") - 1]

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the wavelet matrix sends a place of the transform, read as each symbol."""
        depth = len(self.levels)
        for k, level in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where(symbol >> (depth - 1 - k) & 1 == 1, level.zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The backward step of an interval's bound."""
        return self.first[symbol] + self._walk(symbol, at) - self.base[symbol]

    def statistics(self, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each word of the streamed runs the smallest owner of the WINDOW that starts there, or -1 if none occurs."""
        place = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        symbols = np.where(self.names[place] == hashes, place + 1, -1)
        begin = np.cumsum(length) - length
        out = np.full(len(hashes), -1, np.int64)
        low, high, matched = np.zeros(len(length), np.int64), np.full(len(length), self.size), np.zeros(len(length), np.int64)
        for step in range(int(length.max(initial=0))):
            lanes = np.flatnonzero(length > step)
            at = begin[lanes] + length[lanes] - 1 - step
            absent = symbols[at] < 0
            gone = lanes[absent]
            low[gone], high[gone], matched[gone] = 0, self.size, 0
            lanes, at = lanes[~absent], at[~absent]
            while len(lanes):
                c = symbols[at]
                lo, hi = self.extend(c, low[lanes]), self.extend(c, high[lanes])
                found = hi > lo
                own = lanes[found]
                low[own], high[own] = lo[found], hi[found]
                matched[own] += 1
                whole = matched[own] == WINDOW
                full = own[whole]
                out[at[found][whole]] = self.least[low[full]]
                self._shorten(full, low, high, matched)
                lanes, at = lanes[~found], at[~found]  # drop the match's last word and try again
                self._shorten(lanes, low, high, matched)
        return out

    def _shorten(self, lanes: np.ndarray, low: np.ndarray, high: np.ndarray, matched: np.ndarray) -> None:
        matched[lanes] -= 1
        for k in np.unique(matched[lanes]).tolist():
            own = lanes[matched[lanes] == k]
            high[own] = self.right[k][low[own]]
            low[own] = self.left[k][low[own]]


class Runs(NamedTuple):
    """Runs of windows: row, first window (a word of the row's slice), number of windows, anchor."""

    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


def window_runs(w: Words) -> Runs:
    total = len(w.start)
    row = w.rows()
    count = total - WINDOW + 1
    if count <= 0:
        zero = np.zeros(0, np.int64)
        return Runs(zero, zero, zero, np.zeros(0, np.uint64))
    gram = np.full(total, np.uint64(2**64 - 1))
    h, at = grams(w, ANCHOR)
    gram[at] = h
    least, wide = gram, WINDOW - ANCHOR + 1
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: total - wide + 1], least[wide - span : wide - span + total - wide + 1])[:count]
    valid = np.arange(count) + WINDOW <= w.first[1:][row[:count]]
    new = valid.copy()
    new[1:] = valid[1:] & (~valid[:-1] | (least[1:] != least[:-1]) | (row[1:count] != row[: count - 1]))
    start = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True)) + 1
    size = last - start
    parts = -(-size // RUN_WINDOWS)
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, last = np.repeat(start, parts) + k * RUN_WINDOWS, np.repeat(last, parts)
    return Runs(row[start], start, np.minimum(last - start, RUN_WINDOWS), least[start])


def context_codes(w: Words, r: Runs, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (bucket above, 32 bits below) of the CONTEXT-grams beside each anchor, and the word at which the anchor stands.

    A window has WINDOW - ANCHOR words beside its anchor, so it holds CONTEXT - ANCHOR of them on the right or on the left: two
    documents that share a window share a code. A code that is shared by chance costs work and changes no result.
    """
    total = len(w.start)
    gram = np.full(total, np.uint64(2**64 - 1))
    h, at = grams(w, ANCHOR)
    gram[at] = h
    stands = np.zeros(total, bool)
    size = r.windows + WINDOW - ANCHOR
    place = np.arange(size.sum()) + np.repeat(r.start - (np.cumsum(size) - size), size)
    stands[place[gram[place] == np.repeat(r.anchor, size)]] = True
    wide = np.zeros(total, np.uint64)
    here = np.zeros(total, bool)
    h, at = grams(w, CONTEXT)
    wide[at], here[at] = h, True
    side = CONTEXT - ANCHOR
    right = np.flatnonzero(stands & here)
    left = np.flatnonzero(stands[side:] & here[: max(0, total - side)]) + side
    code = np.concatenate([wide[right], wide[left - side]])
    return ((code >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | code & np.uint64(0xFFFFFFFF), np.concatenate([right, left])


def parts_of(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in chunk.combine_chunks().to_batches():
        yield from slices(batch)


class Part(NamedTuple):
    """A slice of a chunk with its words, runs and codes."""

    rows: pa.RecordBatch
    texts: Texts
    words: Words
    runs: Runs
    code: np.ndarray
    at: np.ndarray


def chunk_codes(chunk: pa.Table, buckets: int) -> tuple[list[Part], np.ndarray, np.ndarray]:
    """The chunk's slices, its distinct codes, in order, and whether two documents of it have each."""
    parts, owner = [], [np.zeros(0, np.uint64)]
    for rows in parts_of(chunk.filter(chunk.column("doc_id").is_valid())):
        t = texts(rows.column("text"))
        w = words(t)
        r = window_runs(w)
        parts.append(Part(rows, t, w, r, *context_codes(w, r, buckets)))
        owner.append(rows.column("doc_id").to_numpy().view(np.uint64)[w.rows()[parts[-1].at]])
    code = np.concatenate([np.zeros(0, np.uint64), *(p.code for p in parts)])
    _, one = np.unique(code ^ mix(np.concatenate(owner)), return_index=True)
    distinct, n = np.unique(code[one], return_counts=True)
    return parts, distinct, n > 1


def codes_in_chunks(dealt: DataFrame, buckets: int) -> DataFrame:
    """chunk, bucket, shared: for each chunk's codes of a bucket, in order, one bit: does another chunk have it too?"""

    def ask(key: tuple, chunk: pa.Table) -> pa.Table:
        _, code, _ = chunk_codes(chunk, buckets)
        bucket = (code >> np.uint64(32)).astype(np.int32)
        heads = np.flatnonzero(np.diff(bucket, prepend=-1))
        low = code.astype(np.uint32)
        blobs = pa.array([low[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(low)], strict=False)], pa.binary())
        return pa.table([pa.array(np.full(len(heads), key[0].as_py(), np.int32)), pa.array(bucket[heads]), blobs], names=["chunk", "bucket", "codes"])

    def judge(key: tuple, asked: pa.Table) -> pa.Table:
        codes = [np.frombuffer(x, np.uint32) for x in asked.column("codes").to_pylist()]
        every, n = np.unique(np.concatenate(codes), return_counts=True)
        every = every[n > 1]
        bits = [np.packbits(np.isin(x, every)).tobytes() for x in codes]
        return pa.table([asked.column("chunk"), asked.column("bucket"), pa.array(bits, pa.binary())], names=["chunk", "bucket", "shared"])

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, codes binary")
    return asked.groupBy("bucket").applyInArrow(judge, "chunk int, bucket int, shared binary")


def shared_runs(dealt: DataFrame, shared: DataFrame, buckets: int, distinct: bool) -> DataFrame:
    """The runs with a code that another document has: anchor, content (a second hash), chunk, doc_id, text_key, start (a word of the document).

    distinct: of equal runs of a slice only the one of the smallest document, with its words as `run`.
    """
    schema = RUNS.append(pa.field("run", pa.binary())) if distinct else RUNS

    def find(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        parts, code, many = chunk_codes(chunk, buckets)
        bounds = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1)) if answers.num_rows else []
        for bucket, bits in zip(answers.column("bucket").to_pylist(), answers.column("shared").to_pylist(), strict=True):
            lo, hi = bounds[bucket : bucket + 2]
            many[lo:hi] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
        code = code[many]
        out = [pa.table([pa.array([], f.type) for f in schema], schema=schema)]
        for part in parts:
            w, r = part.words, part.runs
            wanted = np.zeros(len(w.start) + 1, np.int64)
            wanted[part.at[np.isin(part.code, code)] + 1] = 1
            wanted = np.cumsum(wanted)
            keep = wanted[r.start + r.windows + WINDOW - ANCHOR] > wanted[r.start]
            row, start, n, anchor = (x[keep] for x in r)
            content = np.zeros(len(start), np.uint64)
            for k in range(RUN_WINDOWS + WINDOW - 1):
                live = np.flatnonzero(n + WINDOW - 1 > k)
                if not len(live):
                    break
                content[live] = mix(content[live] * np.uint64(3) + w.hash[start[live] + k])
            if distinct:
                doc = part.rows.column("doc_id").to_numpy()[row]
                order = np.lexsort((doc, content, anchor))
                one = order[np.append(True, (np.diff(content[order]) != 0) | (np.diff(anchor[order]) != 0))[: len(order)]]
                row, start, n, anchor, content = (x[one] for x in (row, start, n, anchor, content))
            columns = [
                pa.array(anchor.view(np.int64)),
                pa.array(content.view(np.int64)),
                pa.array(np.full(len(start), key[0].as_py(), np.int32)),
                part.rows.column("doc_id").take(pa.array(row)),
                part.rows.column("text_key").take(pa.array(row)),
                pa.array((start - w.first[row]).astype(np.int32)),
            ]
            if distinct:
                columns.append(pa.array(run_bytes(part, start, start + n + WINDOW - 1), pa.binary()))
            out.append(pa.table(columns, schema=schema))
        return pa.concat_tables(out).combine_chunks()

    kinds = "anchor long, content long, chunk int, doc_id long, text_key int, start int" + (", run binary" if distinct else "")
    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(find, kinds)


def run_bytes(part: Part, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """The words first[i]:last[i], one space between them."""
    w = part.words
    size = w.end - w.start
    ends = np.cumsum(size + 1)
    flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)  # the words, one space after each
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = part.texts.data[np.repeat(w.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    raw = flat.tobytes()
    return [raw[a:b] for a, b in zip((ends[first] - size[first] - 1).tolist(), (ends[last - 1] - 1).tolist(), strict=True)]


def first_documents(runs: DataFrame) -> DataFrame:
    """anchor, content, firsts: for each window of a distinct run the smallest document that has it. runs: anchor, content, first, run, dealt out by anchor."""

    def search(shard: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(shard).combine_chunks().to_batches()[0]
        owner = rows.column("first").to_numpy()
        w = words(texts(rows.column("run").cast(pa.string())))
        length = np.diff(w.first)
        best = None
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(length) // (4 * SHARD_WORDS)])))
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(length)], strict=True):
            if lo < hi:  # one anchor's runs may need several indexes; all runs are streamed through each
                index = FMIndex(w.hash[w.first[lo] : w.first[hi]], length[lo:hi], owner[lo:hi])
                got = index.statistics(w.hash, length).view(np.uint64)  # -1 is the largest
                best = got if best is None else np.minimum(best, got)
        windows = length - WINDOW + 1
        at = np.arange(windows.sum()) + np.repeat(w.first[:-1] - (np.cumsum(windows) - windows), windows)
        ends = np.concatenate([[0], np.cumsum(windows)]).astype(np.int32)
        firsts = pa.ListArray.from_arrays(pa.array(ends), pa.array(best.view(np.int64)[at]))
        return pa.RecordBatch.from_arrays([rows.column("anchor"), rows.column("content"), firsts], names=["anchor", "content", "firsts"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            lengths = np.cumsum(np.diff(np.frombuffer(batch.column("run").buffers()[1], np.int32)[batch.column("run").offset :][: batch.num_rows + 1])) // 6
            begin = 0
            new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            if held and len(anchor) and held[-1].column("anchor")[-1].as_py() == anchor[0]:
                new = new[1:]
            for k in new.tolist():
                done = int(lengths[k - 1]) if k else 0
                base = int(lengths[begin - 1]) if begin else 0
                if size + done - base >= SHARD_WORDS:
                    if k > begin:
                        held.append(batch.slice(begin, k - begin))
                    yield search(held)
                    held, size, begin = [], 0, k
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
                size += int(lengths[-1]) - (int(lengths[begin - 1]) if begin else 0)
        if held:
            yield search(held)

    return runs.sortWithinPartitions("anchor").mapInArrow(shards, "anchor long, content long, firsts array<long>")


def _keys(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """A hash of doc_id and text_key, which tells the rows of a chunk apart; no row without an id is looked up."""
    doc, text = (rows.column(c).fill_null(0).to_numpy().astype(np.int64).view(np.uint64) for c in ("doc_id", "text_key"))
    return mix(mix(doc) * np.uint64(3) + text)


def cut_out(dealt: DataFrame, starts: DataFrame) -> DataFrame:
    """Takes the words of the windows that begin at the words `s` out of each row. starts: chunk, doc_id, text_key, s."""

    def cut(chunk: pa.Table, starts: pa.Table) -> pa.Table:
        starts = starts.combine_chunks()
        lists = starts.column("s").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
        key = np.repeat(_keys(starts), sizes)
        order = np.argsort(key, kind="stable")
        key, begins = key[order], lists.flatten().to_numpy()[order].astype(np.int64)
        out = [pa.table([pa.array([], f.type) for f in CUT], schema=CUT)]
        for part in parts_of(chunk):
            t = texts(part.column("text"))
            w = words(t, hashed=False)
            own = _keys(part)
            lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            n = np.where(part.column("doc_id").is_valid().to_numpy(zero_copy_only=False), hi - lo, 0)
            at = begins[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)] + np.repeat(w.first[:-1], n)
            gone = covered(len(w.start), at, WINDOW)
            raw, digests = t.data.tobytes(), []
            begin, end, first = w.start.tolist(), w.end.tolist(), w.first.tolist()
            kept = np.flatnonzero(~gone)
            bounds = np.searchsorted(kept, w.first).tolist()
            kept = kept.tolist()
            for r in range(part.num_rows):
                left = kept[bounds[r] : bounds[r + 1]]
                if len(left) == first[r + 1] - first[r]:
                    joined = b" ".join(raw[t.offsets[r] : t.offsets[r + 1]].split())
                else:
                    joined = b" ".join([raw[begin[k] : end[k]] for k in left])
                digests.append(hashlib.sha256(joined).hexdigest())
            out.append(pa.table([part.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(per_row(gone, w.first).astype(np.int64)), pa.array(digests, pa.string())], schema=CUT))
        return pa.concat_tables(out).combine_chunks()

    return dealt.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInArrow(cut, RESULT)


def substring_dedup(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window that covers it starts in a document with a smaller id too. Null and empty texts have no words; a
    text under WINDOW words has no window. Rows that repeat an id are one document: they don't remove each other. A null id is
    no source and loses nothing. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    chunks, buckets = (max(1, -(-chars // n)) for n in (chunk_chars, 2 * chunk_chars))
    # Dealt out once, and read again by each step; rows without an id are spread by their text.
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.length("text")), F.lit(chunks)).cast("int")
    dealt = rows.select("doc_id", "text", F.hash("text").alias("text_key"), chunk.alias("chunk")).repartition(F.col("chunk"))
    shared = codes_in_chunks(dealt, buckets)
    # Equal runs are combined in their chunks already; one exchange by anchor then serves both the combining and the index.
    distinct = shared_runs(dealt, shared, buckets, distinct=True).select("anchor", "content", "doc_id", "run").repartition(F.col("anchor"))
    firsts = first_documents(distinct.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.first("run").alias("run")))
    again = shared_runs(dealt, shared, buckets, distinct=False).join(firsts, ["anchor", "content"])
    mine = F.expr("filter(transform(firsts, (first, i) -> IF(first < doc_id, start + i, -1)), x -> x >= 0)")
    return cut_out(dealt, again.select("chunk", "doc_id", "text_key", mine.alias("s")).where(F.size("s") > 0))
