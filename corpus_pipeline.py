"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, mixing, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of documents, whatever
else docs has. Null ids, null, empty and very long texts, ties and repeated rows are as each operator's docstring says; an empty table
gives an empty table at every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from wardline.llm._core import bound_batches, checkpoint_dir, discard, scratch
from wardline.llm.exact_dedup import keep_first_copies
from wardline.llm.mixing import Mix, mix_sources
from wardline.llm.ngram_join import keep_one_of_each
from wardline.llm.packing import Limits, best_fit_packing
from wardline.llm.quality import keep_good
from wardline.llm.queries import DOMAINS, vocabulary

#: Four fifths of the tokens, at most two epochs of a leaf.
MIX = Mix({**{(d,): w for d, w in DOMAINS.items()}, **{(d, "en"): 2.0 for d in DOMAINS}}, budget=0.8, max_epochs=2)
#: At most 64 documents share a sequence.
LIMITS = Limits(documents=64)
#: Bytes of a batch between Spark and Python, and rows of a batch that Parquet readers fill: each stage's batches come after those of the others in the same processes.
BATCH_BYTES = 1 << 19
READER_ROWS = 512
#: Runs that packing keeps, for the length of a task: other stages run in its workers.
KEPT = 100_000


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches of at most BATCH_BYTES, whose buffers and arrays both sides of a task hold several times, and small batches of readers."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark, BATCH_BYTES)
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs, batch_bytes=BATCH_BYTES)


@bounded
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, that of the smallest id."""
    return keep_first_copies(docs)


@bounded
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets of similarity 0.8 or more, that of the smallest id."""
    return keep_one_of_each(docs)


@bounded
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs, MIX).select(*docs.columns)


@bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return best_fit_packing(docs, vocabulary(), LIMITS, kept=KEPT)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Perplexity, links and packing are beyond SQL; tests/llm hold each stage and run() against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Tables that a stage made on its way, and its input, are removed once it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            discard(spark, [last])
        docs, last = spark.read.parquet(path), path
    return docs
