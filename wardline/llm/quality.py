"""Quality rules with n-gram perplexity bands.

Counting rules come first. Then a modified Kneser-Ney model of byte ORDER-grams, case and symbols as they are, is counted by Spark
over all documents. One model serves all languages, so that a document with a passage in another language of the table stays near its
band: the bytes before a byte tell the model which language it reads. Its probabilities stand in sorted arrays of gram hashes. A model
of at most MODEL_ENTRIES grams is sent to every task; a larger one stays in parts, and each chunk of documents asks for the
grams it holds (`_lookup`), with the same results. Bands are those of each language: a document whose perplexity for a byte or for a
word is outside its language's band is rejected; a band is the median of the language's documents that pass the counting rules, give or
take WIDTH times their median distance from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._core import BATCH_BYTES, SPACES, Texts, Words, bound_batches, column, covered, grams, materialize, mix, per_row, run_hash, slices, texts, unused, words
from ._lookup import HashArrays, Tally, answers, deal, parts_of, received

#: The symbols counted by n_symbols.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
WINDOW = 5
REPEAT_PERCENT = 20
ORDER = 4
#: Half a band, in median distances. The mean over few bytes or words varies more: a distance counts sqrt(1 + FEW / n) times less.
WIDTH = 7.0
FEW_BYTES, FEW_WORDS = 1000, 300
#: A median distance is at least this share of the median, so that a language of a few alike documents has a band too.
LEAST_SPREAD = 0.004
#: Grams, of 16 bytes each, up to which the model is broadcast.
MODEL_ENTRIES = 1 << 22
CHUNK_CHARS = 24_000_000
SLICE = 1 << 20
HELD_GRAMS = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in COUNTS) + ", n_grams long, log10_p double"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[SPACES] = 32


def counting_rules(t: Texts, w: Words) -> dict[str, np.ndarray]:
    """The counts of each row, from its words."""
    leads = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    h, at = grams(w, WINDOW)
    row = w.rows()
    key = h ^ mix(row[at].astype(np.uint64) + np.uint64(1))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    repeated = covered(len(w.start), at[count[inverse] > 1], WINDOW) if len(at) else np.zeros(len(w.start), bool)
    lines = words(t, _LINE, hashed=False)
    has_word = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
    keep = np.flatnonzero(has_word)
    line_row = lines.rows()[keep]
    line_key = run_hash(t.data, lines.start[keep], lines.end[keep]) ^ mix(line_row.astype(np.uint64) + np.uint64(1))
    first = np.unique(line_key, return_index=True)[1]
    again = np.ones(len(keep), np.int64)
    again[first] = 0
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_row(leads[w.end] - leads[w.start], w.first),
        "n_symbols": symbol[t.offsets[1:]] - symbol[t.offsets[:-1]],
        "n_dup_lines": np.bincount(line_row, again, len(t.offsets) - 1).astype(np.int64),
        "n_repeat_words": per_row(repeated, w.first),
    }


def byte_grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ORDER - 1 before it (zeros before a row), as one number, and its row. A run of white space is one space."""
    data = _PLAIN[t.data]
    row = np.repeat(np.arange(len(t.offsets) - 1, dtype=np.int32), np.diff(t.offsets))
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32) | (row[1:] != row[:-1])
    data, row = data[keep], row[keep]
    gram = data.astype(np.uint64)
    for k in range(1, ORDER):
        same = row[k:] == row[:-k]
        gram[k:][same] |= data[:-k][same].astype(np.uint64) << np.uint64(8 * k)
    return gram, row


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, n over all documents; a task sends sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(HELD_GRAMS)

        def rows() -> pa.RecordBatch:
            gram, n = tally.empty()
            return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            for part in slices(batch, most=SLICE):
                tally.add(*np.unique(byte_grams(texts(part.column("text")))[0], return_counts=True))
                if tally.full:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """gram, log10_p of all counted grams, by interpolated modified Kneser-Ney. counts: a table of gram, n.

    Below the longest grams a count is that of the different bytes that precede. Every step is a grouping or a join by gram, so it
    holds a model of any size.
    """
    level, levels = counts, [counts.select(F.lit(ORDER).alias("k"), "gram", "n")]
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy((F.col("gram") % (1 << 8 * k)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        levels.append(level.select(F.lit(k).alias("k"), "gram", "n"))
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    every = materialize(every)
    c = [F.greatest(F.lit(1), F.count_if(F.col("n") == i)).cast("double") for i in (1, 2, 3, 4)]
    y = c[0] / (c[0] + 2 * c[1])
    between = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    discounts = every.groupBy("k").agg(
        between(1 - 2 * y * c[1] / c[0], 0.05, 0.95).alias("d1"), between(2 - 3 * y * c[2] / c[1], 0.1, 1.9).alias("d2"), between(3 - 4 * y * c[3] / c[2], 0.15, 2.85).alias("d3")
    )
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    context = Window.partitionBy("k", F.shiftright("gram", 8))  # at most 256 rows
    terms = every.join(F.broadcast(discounts), "k").withColumn("d", d)
    terms = terms.withColumn("total", F.sum("n").over(context)).withColumn("left", F.sum("d").over(context))
    terms = materialize(terms.select("k", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("share")))
    p = terms.where("k = 1").select("gram", (F.col("own") + F.col("share") / 256).alias("p"))
    for k in range(2, ORDER + 1):
        lower = p.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        upper = terms.where(F.col("k") == k).withColumn("suffix", F.col("gram") % (1 << 8 * (k - 1)))
        p = upper.join(lower, "suffix").select("gram", (F.col("own") + F.col("share") * F.col("lower")).alias("p"))
    return p.select("gram", F.log10("p").alias("log10_p"))


def hashed(model: DataFrame) -> DataFrame:
    """key, value of the model's grams."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(column(b, "gram").view(np.uint64)).view(np.int64)), b.column("log10_p").cast(pa.float64())], names=["key", "value"])

    return model.mapInArrow(each, "key long, value double")


def _keys(part: pa.RecordBatch) -> np.ndarray:
    return mix(byte_grams(texts(part.column("text")))[0])


def judge(part: pa.RecordBatch, model: HashArrays) -> pa.RecordBatch:
    """The counts and the model's log10 probability of each row."""
    t = texts(part.column("text"))
    got = counting_rules(t, words(t))
    gram, row = byte_grams(t)
    p = model.get(mix(gram))
    size = np.bincount(row, minlength=part.num_rows)
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("lang"), *(pa.array(got[c], pa.int64()) for c in COUNTS), pa.array(size, pa.int64()), pa.array(np.bincount(row, p, part.num_rows).astype(float))],
        names=["doc_id", "lang", *COUNTS, "n_grams", "log10_p"],
    )


def document_stats(docs: DataFrame, model: DataFrame, entries: int = MODEL_ENTRIES, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The counts of each document and its n_grams and log10_p. model: a table of key, value."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    if model.count() <= entries:
        table = model.toPandas()
        arrays = HashArrays.of(table["key"].to_numpy().view(np.uint64), table["value"].to_numpy())
        shared = docs.sparkSession.sparkContext.broadcast(arrays)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, most=SLICE):
                    yield judge(part, shared.value)

        return rows.mapInArrow(score, STATS)

    dealt, chunks = deal(rows, chunk_chars)
    given = answers(dealt, _keys, model, -(-chunks // 2))

    def in_chunk(own: pa.Table, given: pa.Table) -> pa.Table:
        arrays = received(own, _keys, given)
        return pa.Table.from_batches([judge(part, arrays) for part in parts_of(own)])

    return dealt.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(in_chunk, STATS)


def quality_rules(docs: DataFrame, width: float = WIDTH, entries: int = MODEL_ENTRIES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of docs with the counts, base_failed, kept, the perplexities and their bands.

    Null and empty texts have no words, so base_failed. A null language has a band of its own. Texts of any length are scored whole.
    An empty table gives no rows; repeated rows are judged alike; other columns of docs are ignored.
    """
    bound_batches(docs.sparkSession, batch_bytes)
    model = materialize(hashed(kneser_ney(materialize(gram_counts(docs)))))
    stats = materialize(document_stats(docs, model, entries))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    measures = (("byte", "n_grams", FEW_BYTES), ("word", "n_words", FEW_WORDS))
    at = {name: -F.col("log10_p") / F.greatest(F.col(n), F.lit(1)) for name, n, _ in measures}
    stretch = {name: F.sqrt(1 + F.lit(float(few)) / F.greatest(F.col(n), F.lit(1))) for name, n, few in measures}
    stats = stats.withColumns({name: at[name] for name in at})
    usual = stats.where(~failed)
    half = lambda c: F.percentile_approx(c, 0.5, 10000)
    middle = usual.groupBy(F.col("lang").alias("of")).agg(*(half(F.col(name)).alias(f"{name}_middle") for name in at))
    apart = {name: F.abs(F.col(name) - F.col(f"{name}_middle")) / stretch[name] for name in at}
    own = F.col("lang").eqNullSafe(F.col("of"))
    spread = usual.join(middle, own).groupBy("of").agg(*(half(apart[name]).alias(f"{name}_spread") for name in at), *(F.first(f"{name}_middle").alias(f"{name}_middle") for name in at))
    judged = stats.join(spread, own, "left")  # a row for each language
    wide = {name: width * F.greatest(F.col(f"{name}_spread"), LEAST_SPREAD * F.col(f"{name}_middle")) * stretch[name] for name in at}
    bounds = {f"{name}_{side}": F.col(f"{name}_middle") + sign * wide[name] for name in at for side, sign in (("lower", -1), ("upper", 1))}
    judged = judged.withColumns(bounds)
    inside = F.col("byte").between(F.col("byte_lower"), F.col("byte_upper")) & F.col("word").between(F.col("word_lower"), F.col("word_upper"))
    return judged.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & F.coalesce(inside, F.lit(False))).alias("kept"),
        F.col("byte").alias("log10_perplexity"), F.col("byte_lower").alias("band_lower"), F.col("byte_upper").alias("band_upper"),
        F.col("word").alias("log10_word_perplexity"), F.col("word_lower").alias("word_band_lower"), F.col("word_upper").alias("word_band_upper"),
    )


def keep_good(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names. Rows with one doc_id share the verdict of the worst."""
    name = unused(docs, "id")
    bad = materialize(quality_rules(docs, **parameters).where("not kept").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad[name]), "left_anti")
