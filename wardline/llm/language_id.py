"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built; parsing a text with it greedily takes the longest phrase
that occurs in that text, again and again. The language that needs the fewest phrases per symbol, normalised by what it
needs for its own held-back text, wins. All documents of a task are parsed in step, as rows of one array.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._core import SLICE_BYTES, SYMBOL, Texts, slices, texts

FOLDS = 4
HELD_OUT = 2
#: The training text of a language: the documents with the smallest hashes, at most so many of them and so many symbols.
TRAIN_DOCS = 200
TRAIN_SYMBOLS = 40_000
CHECK_SYMBOLS = 10_000
#: The symbols of all languages together; with more than sixteen languages each gets a smaller share. This bounds the parser.
ALL_SYMBOLS = 16 * TRAIN_SYMBOLS
#: No phrase crosses a line end or runs over so many symbols of a line: the parse begins anew there, and every symbol is parsed.
SEGMENT = 512
SCHEMA = "doc_id long, lang_pred string, score double"


class Parser(NamedTuple):
    """moves[language, state * 64 + symbol]: the next state, 0 if the phrase ends; usual: phrases a symbol in the language's own text."""

    languages: tuple[str, ...]
    moves: np.ndarray
    usual: np.ndarray


def automaton_moves(symbols: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of one string, 64 for each state; state 0 is the root, to which no move leads."""
    most = 2 * len(symbols) + 2
    nxt = np.zeros((most, 64), np.int32)
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        new, p = len(link), last
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and not nxt[p, c]:
            nxt[p, c] = new
            p = link[p]
        if p >= 0:
            q = int(nxt[p, c])
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                nxt[copy] = nxt[q]
                link[q] = link[new] = copy
                while p >= 0 and nxt[p, c] == q:
                    nxt[p, c] = copy
                    p = link[p]
        last = new
    return nxt[: len(link)]


#: Digits, punctuation and symbols tell languages apart no better than a space does.
_LETTERS = np.where((SYMBOL >= 27) & (SYMBOL <= 30), 0, SYMBOL).astype(np.uint8)


def segments(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of letters with one for each run of other characters, and the begin, end and row of each segment."""
    sym = _LETTERS[t.data]
    row = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    line = np.concatenate([[0], np.cumsum(t.data == 10)[:-1]]) if len(sym) else np.zeros(0, np.int64)
    sym, row, line = sym[keep], row[keep], line[keep]
    if not len(sym):
        zero = np.zeros(0, np.int64)
        return sym, zero, zero, zero
    new = np.ones(len(sym), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(sym)))
    parts = -(-size // SEGMENT)
    begin = np.repeat(begin, parts) + SEGMENT * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    return sym, begin, np.append(begin[1:], len(sym)), row[begin]


def count_phrases(sym: np.ndarray, begin: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Phrases[language, segment] of the greedy parse; all segments go forward one symbol at a time."""
    order = np.argsort(begin - end, kind="stable")  # the longest first, so that those under way are a prefix
    begin, size = begin[order], (end - begin)[order]
    languages = len(moves)
    state = np.zeros((languages, len(begin)), np.int32)
    count = np.zeros((languages, len(begin)), np.int32)
    active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # active[k]: segments longer than k
    for k, n in enumerate(active.tolist()):
        c = sym[begin[:n] + k].astype(np.int32)
        for x in range(languages):
            s = moves[x].take((state[x, :n] << 6) + c)
            ended = np.flatnonzero(s == 0)
            again = moves[x].take(c[ended])  # the next phrase begins with this symbol, or is this symbol alone if it was never seen
            count[x, ended] += 1 + ((again == 0) & (state[x, ended] != 0))
            s[ended] = again
            state[x, :n] = s
    out = np.empty_like(count)
    out[:, order] = count + (state != 0)
    return out


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Parser:
    """Fits the parser on a bounded sample of each language's documents outside the held-out fold."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    fit = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold != HELD_OUT)).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("same"))

    def first(rows: DataFrame) -> DataFrame:
        """At most train_docs rows of a language, also where ids repeat."""
        rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "same"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= train_docs)

    ids = sorted({r["doc_id"] for r in first(fit.select("doc_id", "lang", "h", "same")).select("doc_id").collect()})
    own = fit.where(F.col("doc_id").isin(ids)).withColumn("text", F.substring("text", 1, 4000))
    got = first(own).select("lang", "text", "h", "doc_id", "rank").collect() if ids else []
    by: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["rank"])):
        by.setdefault(r["lang"], []).append(r["text"])
    most = min(TRAIN_SYMBOLS, max(64, ALL_SYMBOLS // max(1, len(by))))
    names, moves, checks = tuple(sorted(by)), [], []
    for name in names:
        sym, *_ = segments(texts(pa.array([" ".join(by[name])])))
        cut = min(most, len(sym) * 4 // 5)
        moves.append(automaton_moves(sym[:cut]).ravel())
        checks.append(sym[cut : cut + CHECK_SYMBOLS])
    size = max((len(m) for m in moves), default=64)
    stacked = np.zeros((len(names), size), np.int32)
    for x, m in enumerate(moves):
        stacked[x, : len(m)] = m
    usual = np.ones(len(names))
    for x, sym in enumerate(checks):
        begin = np.arange(0, len(sym), SEGMENT)
        if len(begin):
            usual[x] = count_phrases(sym, begin, np.append(begin[1:], len(sym)), stacked[x : x + 1]).sum() / len(sym)
    return Parser(names, stacked, usual)


def identify_language(docs: DataFrame, parser: Parser) -> DataFrame:
    """One row per row of docs: lang_pred and a score of 0 to 1, the winner's share against the next best.

    `und` (score 0) if the text is null or has no letter, or no language was learned. Ties go to the first name. Repeated
    rows give repeated results; an empty table none. Texts of any length are parsed whole. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for part in slices(batch, most=max(1 << 16, SLICE_BYTES * 16 // max(16, len(p.languages)))):
                t = texts(part.column("text"))
                letters = (t.data | 32) - np.uint8(97) < 26
                total = np.concatenate([[0], np.cumsum(letters)])
                known = total[t.offsets[1:]] > total[t.offsets[:-1]]
                for i in np.flatnonzero(~known):
                    known[i] = any(c.isalpha() for c in part.column("text")[i].as_py() or "")
                cost = np.ones((max(1, len(p.languages)), part.num_rows))
                if p.languages:
                    sym, begin, end, row = segments(t)
                    phrases = count_phrases(sym, begin, end, p.moves)
                    size = np.maximum(1, np.bincount(row, end - begin, part.num_rows))
                    cost = np.stack([np.bincount(row, x, part.num_rows) for x in phrases]) / size / p.usual[:, None]
                best = cost.argmin(axis=0)
                least = cost[best, np.arange(part.num_rows)]
                rest = np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else least * 2
                known &= bool(p.languages)
                score = np.where(known, np.clip(1 - least / np.maximum(rest, 1e-9), 0, 1) ** 0.5, 0.0)
                names = [p.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(predict, SCHEMA)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT


def language_id(docs: DataFrame) -> DataFrame:
    """identify_language with a parser trained on the folds other than HELD_OUT, and held_out."""
    return identify_language(docs, train(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
