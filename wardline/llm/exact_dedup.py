"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after each run of ASCII white space became one space. Every stage groups by the
whole normalised text beside its digest, so equal digests of different texts never merge. A third of all rows may hold
one text: the first stage combines map-side and by salt, so that the second gets one winner per text and salt, and the rows of a
hot text go back to their winner under many keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._core import materialize, unused

SALTS = 16
HOT = 10_000
SPREAD = 64


def normalised(text: Column) -> Column:
    """Null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Ties: the smallest id stays; of repeated rows with that id every one says kept, and a null id counts as the largest.
    Null and empty texts are equal. An empty table gives no rows; other columns of docs are ignored.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), norm.alias("norm"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    local = (
        rows.groupBy("sha", "norm", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    winners = local.groupBy("sha", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # From here on a digest stands for its text, unless two different texts share it: those are told apart by content.
    by_sha = materialize(
        winners.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    )
    single = by_sha.where("texts = 1").drop("texts")
    # At most HOT digests stand for a share of 1 / HOT of all rows or more; their rows meet their winner under SPREAD keys each.
    rows_in_all = by_sha.agg(F.sum("group_size")).first()[0] or 0
    hot = single.where(F.col("group_size") > max(1, rows_in_all // HOT)).select("sha", F.lit(SPREAD).alias("keys"))
    keyed = rows.select("doc_id", "sha").join(F.broadcast(hot), "sha", "left")
    keyed = keyed.withColumn("key", F.when(F.col("keys").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))))
    given = single.join(F.broadcast(hot), "sha", "left").withColumn("key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("keys") - 1, F.lit(0)))))
    out = keyed.join(given.select("sha", "key", "keep_id", "group_size"), ["sha", "key"]).select(*_columns())
    clash = by_sha.where("texts > 1").select("sha")
    if not clash.isEmpty():  # no such pair of texts is known
        out = out.unionByName(rows.join(clash, "sha").join(winners.join(clash, "sha"), ["sha", "norm"]).select(*_columns()))
    return out


def _columns() -> list[Column]:
    return [
        F.col("doc_id"),
        F.col("keep_id"),
        F.col("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ]


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has no equal with a smaller id, with all their columns, whatever their names.

    Of rows that repeat the winning id with an equal text one stays; rows of one id with different texts are judged each by its text.
    """
    of, sha = unused(docs, "of"), unused(docs, "sha")
    lost = exact_dedup(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias(of), F.unhex("text_sha256").alias(f"{sha}_")).distinct()
    lost = materialize(lost)
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(F.col(text_col)), 256)))
    first = hashed.join(lost, F.col(id_col).cast("bigint").eqNullSafe(F.col(of)) & (F.col(sha) == F.col(f"{sha}_")), "left_anti")
    repeated = docs.groupBy(F.col(id_col).alias(of)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (first if repeated.isEmpty() else first.dropDuplicates([id_col, sha])).drop(sha)
