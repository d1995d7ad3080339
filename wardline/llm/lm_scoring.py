"""Language-model scoring: prediction by partial matching over a byte-context trie, beside a unigram base.

Training counts all bytes in contexts of up to ORDER bytes over all training documents. A symbol's code length comes from
the longest context that has seen it; each longer one adds its escape (estimate C: distinct / (total + distinct)), and
symbols that a longer context has seen are excluded from the shorter ones. Because the symbols seen in a context are a
subset of those of its suffix, exclusion needs one sum for each context, so probabilities are computed once per gram.

Neither the vocabulary nor the trie is broadcast: documents are dealt to chunks of a bounded size, and each chunk asks for the
words and grams that it holds (`_lookup`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import LOWER, Texts, materialize, mix, slices, texts, words
from ._lookup import Tally, answers, deal, parts_of, received

ORDER = 4
FOLDS = 7
HELD_OUT = 2
CHUNK_CHARS = 8_000_000
WORD, GRAM = 0, 1
COUNTS = "kind byte, key long, n long"
SCORED = "doc_id long, n_tokens long, n_known long, log_sum double, score double"
_GRAM_SALT = np.uint64(0x5851F42D4C957F2D)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def lowered(column: pa.Array) -> Texts:
    t = texts(column)
    return Texts(LOWER[t.data], t.offsets)


def byte_grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each row and its end mark 0: ORDER bytes of context and the byte, as one number; and the rows' bounds. Before a row stand zeros."""
    rows = len(t.offsets) - 1
    pad = ORDER + 1
    data = np.zeros(len(t.data) + pad * rows, np.uint64)
    at = np.arange(len(t.data)) + np.repeat(np.arange(rows) * pad + ORDER, np.diff(t.offsets))
    data[at] = t.data
    gram = data.copy()
    for k in range(1, ORDER + 1):
        gram[k:] |= data[:-k] << np.uint64(8 * k)
    bounds = t.offsets + pad * np.arange(rows + 1)
    real = np.ones(len(data), bool)
    for k in range(ORDER):
        real[bounds[:-1] + k] = False
    return gram[real], t.offsets + np.arange(rows + 1)


def gram_key(gram: np.ndarray) -> np.ndarray:
    """Hashes that stand beside those of words."""
    return mix(gram ^ _GRAM_SALT)


def counted(docs: DataFrame) -> DataFrame:
    """kind, key, n: training counts of word hashes and of grams; grams of other documents come with n = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = Tally(), Tally()
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                train = ~part.column("held_out").to_numpy(zero_copy_only=False)
                t = lowered(part.column("text"))
                w = words(t)
                tallies[WORD].add(*np.unique(w.hash[train[w.rows()]], return_counts=True))
                gram, bounds = byte_grams(t)
                mine = np.repeat(train, np.diff(bounds))
                tallies[GRAM].add(*np.unique(gram[mine], return_counts=True))
                other = np.unique(gram[~mine])
                tallies[GRAM].add(other, np.zeros(len(other), np.int64))
                yield from (_counts(kind, *tally.empty()) for kind, tally in enumerate(tallies) if tally.full)
        yield from (_counts(kind, *tally.empty()) for kind, tally in enumerate(tallies))

    rows = docs.select("text", held_out().alias("held_out")).mapInArrow(count, COUNTS)
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _counts(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and each row's place among them."""
    keys, inverse = np.unique(key, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)), inverse


def ppm_group(gram: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 P(last byte | ORDER bytes before it) of grams that share the two bytes before the last.

    pairs[b, s]: training count of s after b, a table of at most 65,536 numbers. All grams of those contexts must be there.
    """
    p = np.zeros(len(gram))
    done = np.zeros(len(gram), bool)
    symbol = (gram & 255).astype(int)

    def step(count: np.ndarray, total: np.ndarray, distinct: np.ndarray) -> None:
        """One context for each row: total and distinct are those left after exclusion."""
        live = ~done & (total > 0)
        hit = live & (count > 0)
        p[hit] += np.log10(count[hit] / (total + distinct)[hit])
        miss = live & (count == 0)
        p[miss] += np.log10(distinct[miss] / (total + distinct)[miss])
        done[hit] = True

    longer = None  # of the longer contexts: each gram's context, whether it was seen, the place of each row's context
    for k in range(ORDER, 1, -1):
        grams, count, at = _sums(gram & ((1 << 8 * (k + 1)) - 1), n)
        _, total, context = _sums(grams >> 8, count)
        seen = (count > 0).astype(float)
        distinct = np.bincount(context, seen, len(total))
        gone, fewer = np.zeros(len(gram)), np.zeros(len(gram))
        if longer:
            tails, contexts, was_seen, row_context = longer
            own = count[np.searchsorted(grams, tails)]
            gone = np.bincount(contexts, own * was_seen, row_context.max(initial=-1) + 1)[row_context]
            fewer = np.bincount(contexts, was_seen, row_context.max(initial=-1) + 1)[row_context]
        step(count[at], total[context[at]] - gone, distinct[context[at]] - fewer)
        longer = grams & ((1 << 8 * k) - 1), context, seen, context[at]
    per_symbol = np.bincount(symbol, n, 256)
    before = pairs[int(gram[0] >> 8) & 255] if len(gram) else np.zeros(256)
    every = lambda x: np.full(len(gram), float(x))
    step(before[symbol], every(before.sum() - before[per_symbol > 0].sum()), every((before > 0).sum() - (per_symbol > 0).sum()))
    single = pairs.sum(axis=0)
    step(single[symbol], every(single.sum() - single[before > 0].sum()), every((single > 0).sum() - (before > 0).sum()))
    rest = ~done
    p[rest] -= np.log10(np.maximum(1, 256 - (single > 0).sum()))
    return p


def gram_values(counts: DataFrame) -> DataFrame:
    """key, value: log10 probability of each gram. A group is the grams of one two-byte context, the trie's share below it."""
    grams = counts.where(F.col("kind") == GRAM)
    two = grams.groupBy((F.col("key") % 65536).alias("pair")).agg(F.sum("n").alias("n")).collect()  # at most 65,536 rows
    pairs = np.zeros((256, 256))
    for r in two:
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]

    def values(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gram = rows["key"].to_numpy()
        return pd.DataFrame({"key": gram_key(gram.view(np.uint64)).view(np.int64), "value": ppm_group(gram, rows["n"].to_numpy(), pairs)})

    context = F.shiftright("key", 8) % 65536
    return grams.select("key", "n", context.alias("context")).groupBy("context").applyInPandas(values, "key long, value double")


def _keys(part: pa.RecordBatch) -> np.ndarray:
    t = lowered(part.column("text"))
    return np.concatenate([words(t).hash, gram_key(byte_grams(t)[0])])


def lm_scoring(docs: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per row of docs: held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability by the trie).

    Null and empty texts are one end mark. Repeated rows give repeated results. Without training documents the base is
    log10(1) and the trie uniform. Texts of any length are scored whole, in one chunk. An empty table gives no rows; other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = materialize(counted(rows))
    n_train = rows.agg(F.sum((~held_out()).cast("bigint"))).first()[0]
    vocabulary = counts.where((F.col("kind") == WORD) & (F.col("n") > 0))
    known, total = vocabulary.agg(F.count(F.lit(1)), F.sum("n")).first()
    ends = n_train or 0  # every training document has one end token
    train_tokens, distinct = (total or 0) + ends, known + bool(ends)
    values = vocabulary.select("key", F.col("n").cast("double").alias("value")).unionByName(gram_values(counts))
    dealt, chunks = deal(rows, chunk_chars)
    given = answers(dealt, _keys, values, -(-chunks // 2))
    end_value = np.log10(ends + 1)

    def score(own: pa.Table, given: pa.Table) -> pa.Table:
        table = received(own, _keys, given)
        out = []
        for part in parts_of(own):
            t = lowered(part.column("text"))
            w = words(t)
            c = table.get(w.hash)
            gram, bounds = byte_grams(t)
            p = np.concatenate([[0], np.cumsum(table.get(gram_key(gram)))])
            row, n = w.rows(), part.num_rows
            sums = np.bincount(row, np.log10(c + 1), n) + end_value
            hits = np.bincount(row, c > 0, n).astype(np.int64) + bool(ends)
            columns = part.column("doc_id"), pa.array(np.diff(w.first) + 1), pa.array(hits), pa.array(sums), pa.array(p[bounds[1:]] - p[bounds[:-1]])
            out.append(pa.table(list(columns), names=["doc_id", "n_tokens", "n_known", "log_sum", "score"]))
        return pa.concat_tables(out)

    scored = dealt.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(score, SCORED)
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * float(np.log10(train_tokens + distinct + 1))).alias("base_score"),
        "score",
    )
