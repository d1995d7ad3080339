"""Best-fit packing of token sequences by vector best fit.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces come
in falling length; each goes to the open bin that keeps every constraint and has the least residual norm, or the largest
weighted dot product of demand and residual. Pieces are dealt to buckets of a bounded number of pieces, so a task holds
one bucket, whatever the corpus; a bucket costs less than one bin over the best for its own pieces in practice.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, SPACES, Texts, give_back, materialize, slices, texts

TOKENS = 4096
END_ID = 1
BUCKET_PIECES = 8192
#: Runs that a worker keeps in each of two generations, of about 200 bytes each, and the characters of the longest one kept.
KEPT, LONGEST = 500_000, 64
#: Runs that go to the tokenizer at once: its answers are far larger than their ids.
RAW_BATCH = 4096
#: Kinds of bytes. Letters are A-Z, a-z and, in two bytes from C3 on, those of Latin-1; apostrophes and controls are OTHER.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
KIND[39], KIND[SPACES] = OTHER, SPACE
#: Plain runs, and what stands for each byte in the vocabulary where that is not its own character.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[!-&(-/:-@[-`{-~]+").fullmatch
BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not 33 <= b < 127 and not 161 <= b < 173 and b < 174)}
#: Every plain character, alone and beside letters, digits and signs.
SIGNS = "".join(chr(c) for c in range(33, 256) if c != 39 and (c < 127 or c >= 0xC0 and c not in (0xD7, 0xF7)))
PROBE = " ".join((SIGNS, SIGNS[::-1], *SIGNS, *(f"A{c}b{c}{c}1" for c in SIGNS), "\t12 \n The--end\r\v\f"))
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: place: a piece's number among those of its task, which tells repeated rows apart.
PIECES = PIECE + ", place long"
PACKED = PIECE + ", sequence_id long, offset long"


class Limits(NamedTuple):
    """Capacities of a bin, and the weight of each in the choice of a bin."""

    tokens: int = TOKENS
    documents: int = TOKENS
    attention: int = TOKENS * TOKENS
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"


class Recent:
    """Values of the keys used of late: those of two generations, of which the elder goes when the younger is full."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Values of distinct keys; learn gives those of keys without one. All but long keys are young from here on."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        got = list(map(self.young.get, keys))
        rest = [k for k, v in zip(keys, got, strict=True) if v is None]
        if not rest:
            return got
        new = dict(zip(rest, map(self.old.get, rest), strict=True))
        unknown = [k for k, v in new.items() if v is None]
        new.update(zip(unknown, learn(unknown), strict=True))
        self.young.update((k, v) for k, v in new.items() if len(k) <= LONGEST)
        return [new[k] if v is None else v for k, v in zip(keys, got, strict=True)]


def runs_of(t: Texts, kinds: np.ndarray = KIND) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Runs of all texts in order, and how many of them come before each text and in all.

    A chunk between ASCII white space of ASCII characters and Latin-1 letters falls into what the tokenizer takes as words: lower-cased
    letters, single digits, and signs. A chunk with anything else, an apostrophe or "<|" (special tokens begin with it) is one run, unchanged.
    """
    n = len(t.data)
    kind, lower = kinds[t.data], LOWER[t.data]
    if n and t.data.max() >= 0x80:
        lead = np.flatnonzero(t.data[:-1] == 0xC3)
        second = t.data[lead + 1]
        lead, second = lead[(second != 0x97) & (second != 0xB7)], second[(second != 0x97) & (second != 0xB7)]
        kind[lead] = kind[lead + 1] = kinds[97]
        lower[lead[second < 0x9F] + 1] += 32
    inside = kind != SPACE
    begins = np.ones(n + 1, bool)
    begins[1:n] = ~inside[:-1]
    begins[t.offsets] = True
    begins[:n] &= inside
    chunks = np.flatnonzero(begins)
    begins[1:n] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    bars = np.flatnonzero(t.data[:-1] == ord("<"))
    odd = np.append(np.flatnonzero(kind == OTHER), bars[t.data[bars + 1] == ord("|")])
    if len(odd):
        whole = np.unique(np.searchsorted(chunks, odd, "right") - 1)
        edge = np.zeros(n + 1, np.int8)
        edge[chunks[whole]] += 1
        edge[chunks[whole + 1]] -= 1
        within = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        lower[within] = t.data[within]
        begins[:n] &= ~within
        begins[chunks[whole]] = True
    ends = begins[1:] & inside
    ends[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(begins[:n])
    offsets = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - start))
    runs = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(lower[inside]))
    return runs.dictionary_encode(), np.searchsorted(start, t.offsets)


class WordEncoder:
    """Ids of texts by runs, which this kind of tokenizer never joins.

    A plain run goes to the tokenizer's model as it is, since the normaliser and the splitting expression would change nothing;
    a tokenizer that does not agree with that on PROBE gets every white-space chunk itself.
    """

    def __init__(self, path: str, kept: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        self.bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.kinds, self.plain = KIND, PLAIN
        self.runs = Recent(kept)
        if self.encode(texts(pa.array([PROBE]))) != [self._ids(PROBE)]:
            self.kinds, self.plain = np.where(SPACES, SPACE, OTHER).astype(np.uint8), lambda run: None
        self.runs = Recent(kept)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, missing: list[str]) -> list[bytes]:
        """Ids of runs. Many that are not plain go to the tokenizer as one text, and each token falls to the run in which it starts."""
        word, ids = self.word, self.bytes
        out, rest = [b""] * len(missing), []
        for k, c in enumerate(missing):
            if "<|" in c:
                out[k] = self._ids(c)
            elif not self.plain(c):
                rest.append(k)
            else:
                out[k] = b"".join([ids[x.id] for x in word(c if c.isascii() else c.encode().decode("latin-1").translate(BYTE_SIGNS))])
        for at in range(0, len(rest), RAW_BATCH):
            part = rest[at : at + RAW_BATCH]
            some = [missing[k] for k in part]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.array([a for a, _ in got.offsets], np.int64)
            bounds = (4 * np.searchsorted(starts, np.append(0, np.cumsum([len(c) + 1 for c in some])))).tolist()
            data = np.array(got.ids, "<u4").tobytes()
            for k, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
                out[k] = data[a:b]
        return out

    def encode(self, t: Texts) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        runs, first = runs_of(t, self.kinds)
        values = self.runs.values(runs.dictionary.to_numpy(zero_copy_only=False).tolist(), self.learn)
        found = pa.array(values, pa.large_binary()).take(runs.indices)
        bounds = np.frombuffer(found.buffers()[1], np.int64)[first].tolist()
        data = memoryview(found.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int) -> WordEncoder:
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = WordEncoder(path, kept)
    return _ENCODERS[path, kept]


def token_pieces(docs: DataFrame, vocabulary: str, most: int = TOKENS, end_id: int = END_ID, kept: int = KEPT) -> DataFrame:
    """A row for each piece of at most `most` ids of each document; the document ends with end_id. Null text: empty.

    A worker keeps `kept` runs of late for its next task; fewer than KEPT are forgotten, with the tokenizer, when a task ends.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, kept).encode
        place = 0
        for batch in batches:
            for part in slices(batch):
                rows: list[tuple] = []
                for doc, got in zip(part.column("doc_id").to_pylist(), encode(texts(part.column("text"))), strict=True):
                    got += end
                    for k, at in enumerate(range(0, len(got), 4 * most)):
                        piece = got[at : at + 4 * most]
                        rows.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), place))
                        place += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "place"],
                )
        if kept < KEPT:
            _ENCODERS.clear()
            give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_fit(length: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    capacity = np.array([limits.tokens, limits.documents, limits.attention], np.float64)
    weight = np.array(limits.weights) / capacity**2
    order = np.argsort(-length, kind="stable")
    bin_of, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    used = 0
    least = length.min() if len(length) else 0
    free = np.empty((256, 3))
    names = np.empty(256, np.int64)
    n = 0
    for i in order:
        demand = np.array([length[i], 1.0, float(length[i]) ** 2])
        if (demand > capacity).any():
            raise ValueError(f"a piece of {length[i]} tokens is over the limits {limits}")
        room = free[:n] - demand
        fits = np.flatnonzero((room >= 0).all(axis=1)) if n else ()
        if len(fits):
            if limits.rule == "norm":
                best = fits[np.argmin((room[fits] ** 2) @ weight)]
            else:
                best = fits[np.argmax(free[fits] @ (demand * weight))]
        else:
            if n == len(free):
                free, names = np.vstack([free, np.empty_like(free)]), np.concatenate([names, np.empty_like(names)])
            free[n], names[n], best = capacity, used, n
            used, n = used + 1, n + 1
        bin_of[i], offset[i] = names[best], limits.tokens - free[best, 0]
        free[best] -= demand
        if free[best, 0] < least or free[best, 1] < 1 or free[best, 2] < least * least:  # no piece fits any more
            n -= 1
            free[best], names[best] = free[n], names[n]
    return bin_of, offset


def pack_pieces(pieces: DataFrame, limits: Limits = Limits(), bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Adds sequence_id and offset. pieces is read twice; pass a table or a checkpoint."""
    buckets = max(1, -(-pieces.count() // bucket_pieces))

    def fill(key: tuple, rows: pa.Table) -> pa.Table:
        # Arrow keeps every long as it is; through pandas a column with a null would round the ids beside it.
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "place")])
        bins, offset = best_fit(rows.column("length").to_numpy(), limits)
        rows = rows.drop_columns(["bucket", "place"])
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offset))

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(fill, PACKED)


def best_fit_packing(docs: DataFrame, vocabulary: str, limits: Limits = Limits(), kept: int = KEPT) -> DataFrame:
    """Packs every document into sequences of at most limits.tokens tokens; one row per piece.

    Only documents longer than that are cut. Null and empty texts are one end token; a very long text is as many pieces as it takes.
    Repeated rows and rows that repeat an id or have none are packed as often as they come. Pieces of one length go by id, piece and
    content; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(materialize(token_pieces(docs, vocabulary, limits.tokens, kept=kept)), limits)
