"""Mixing sources to target weights by hierarchical budgeting.

Weights propagate through a domain - language - source tree. A child that lacks tokens for its share gives the shortage to
its siblings in proportion to their weights; only what a whole family lacks goes to the family's own siblings. Each leaf
then takes whole seeded epochs of its documents and a token prefix of one more. The tree is divided level by level with windows
over families, so it may have any number of leaves.

A leaf may hold a third of all rows: the place of the prefix's end is found from sums over HASH_BUCKETS ranges of the
seeded order, and only the rows of the one range in which it falls are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import materialize, unused

LEVELS = ("domain", "lang", "source")
HASH_BUCKETS = 1 << 14
#: Leaves up to which the plan is sent to every task; a larger plan meets the documents in a shuffle.
BROADCAST_LEAVES = 50_000


class Mix(NamedTuple):
    """Target weights by path prefix, such as ("d0",) or ("d0", "en"); a path that is missing weighs 1 beside its siblings."""

    weights: Mapping[tuple[str, ...], float]
    budget: float = 0.5
    max_epochs: int = 4
    seed: int = 17


def water_fill(children: DataFrame, family: list[str], name: str) -> DataFrame:
    """Adds share: the family's amount in proportion to weight, none over its capacity; what one can't take goes to the others.

    children: family, name, weight, capacity (0 where weight is 0), amount (the same in a family). In the order of capacity for a
    unit of weight the first children are full; the level of the first that is not gives the rest their shares.
    """
    every = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    order = every.orderBy("ratio", name)
    left = F.least(F.col("amount"), F.sum("capacity").over(every))
    out = children.withColumn("ratio", F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.col("capacity") / F.col("weight")))
    out = out.withColumn("left", left)
    taken = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum(F.when(F.col("ratio").isNotNull(), F.col("weight"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    out = out.withColumn("level", (F.col("left") - taken) / weight)
    short = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", name, "level"))
    out = out.withColumn("first", F.min(short).over(every)["level"])
    full = F.col("first").isNull() | (F.col("level") >= F.col("ratio"))
    share = F.when(F.col("ratio").isNull(), 0.0).when(full, F.col("capacity")).otherwise(F.col("first") * F.col("weight"))
    return out.withColumn("share", share).drop("ratio", "left", "level", "first")


def given_weights(spark: SparkSession, mix: Mix, path: list[str]) -> DataFrame:
    """path, weight of the mix's paths of that length. They go through Arrow: rows would start Python workers of their own on the executors, which then idle beside those of other stages."""
    rows = [(*p, float(w)) for p, w in mix.weights.items() if len(p) == len(path)]
    schema = pa.schema([*((c, pa.string()) for c in path), ("weight", pa.float64())])
    return spark.createDataFrame(pa.table(list(zip(*rows, strict=True)) or [[] for _ in schema], schema=schema))


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, n tokens) with share: the tokens to take from each."""
    spark = leaves.sparkSession
    tree = leaves.withColumn("capacity", F.col("n").cast("double") * mix.max_epochs)
    levels = []
    for k in (3, 2, 1):
        path = list(LEVELS[:k])
        given = F.broadcast(given_weights(spark, mix, path))  # as large as the mix that the caller wrote
        nodes = tree.groupBy(*path).agg(F.sum("capacity").alias("capacity")).join(given, path, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        tree = nodes.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0))
        levels.append(materialize(tree))
    total = leaves.agg(F.sum("n")).first()[0] or 0
    above = None
    for k, nodes in zip((1, 2, 3), reversed(levels), strict=True):
        family = list(LEVELS[: k - 1])
        nodes = nodes.withColumn("amount", F.lit(mix.budget * total)) if above is None else nodes.join(above, family)
        above = water_fill(nodes, family, LEVELS[k - 1]).select(*LEVELS[:k], F.col("share").alias("amount"))
    return leaves.join(above.withColumnRenamed("amount", "share"), list(LEVELS))


def default_domain() -> Column:
    """The source's number modulo 4, as d0 to d3; other names are `d-`."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise(F.lit("d-"))


class Taken(NamedTuple):
    """Names of the columns that mix_sources adds: `__domain`, `__tokens` and `__epoch`, with more underscores if docs has them."""

    domain: str
    tokens: str
    epoch: str


def taken_columns(docs: DataFrame) -> Taken:
    return Taken(*(unused(docs, f"__{c}") for c in Taken._fields))


def mix_sources(docs: DataFrame, mix: Mix, domain: Column | None = None) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns and those of taken_columns: the domain, the tokens, the epoch (0, 1, ... for a row taken again).

    Tokens are words `[^\\x20\\x09-\\x0D]+`. mix.budget is a share of all tokens; no leaf exceeds its share. Null lang or source is a
    leaf named "". Null ids and texts are rows like others, and so are rows that repeat an id or whole rows: each is taken or left on its own.
    Documents without words cost nothing and come with the epochs of their leaf. An empty table gives no rows.
    """
    domain = default_domain() if domain is None else domain
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    leaf = [domain.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]
    mark = F.xxhash64("doc_id", "text").alias("mark")
    small = materialize(docs.select(*leaf, mark, words.alias("tokens")))
    leaves = materialize(small.groupBy(*LEVELS).agg(F.sum("tokens").alias("n")))
    planned = leaf_budgets(leaves, mix)
    full = F.when(F.col("n") > 0, F.floor(F.col("share") / F.col("n"))).otherwise(mix.max_epochs).cast("int")
    planned = planned.withColumn("full", full).withColumn("rest", F.when(F.col("full") < mix.max_epochs, F.floor(F.col("share") - F.col("full") * F.col("n"))).otherwise(0).cast("bigint"))
    planned = materialize(planned.select(*LEVELS, "full", "rest"))
    sent = F.broadcast if planned.count() <= BROADCAST_LEAVES else lambda df: df

    def ordered(df: DataFrame) -> DataFrame:
        df = df.withColumn("h", F.xxhash64(F.lit(mix.seed), "full", "mark"))
        return df.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(HASH_BUCKETS)).cast("int"))

    keyed = ordered(small.join(sent(planned), list(LEVELS)))
    before = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # The first range that the prefix can't take whole; without one, the whole epoch is within the rest.
    cross = sums.where(F.col("before") + F.col("n") > F.col("rest")).groupBy(*LEVELS).agg(F.min(F.struct("bucket", "before")).alias("x"))
    ends = planned.join(cross, list(LEVELS), "left")
    ends = materialize(ends.select(*LEVELS, "full", "rest", F.coalesce("x.bucket", F.lit(HASH_BUCKETS)).alias("cross"), F.coalesce("x.before", F.lit(0)).alias("before")))

    rows = ordered(docs.select(F.struct("*").alias("row"), *leaf, mark, words.alias("tokens")).join(sent(ends), list(LEVELS)))
    taken = taken_columns(docs)
    last = [F.col("domain").alias(taken.domain), F.col("tokens").alias(taken.tokens), F.col("epoch").alias(taken.epoch)]
    whole = rows.withColumn("copies", F.col("full") + (F.col("bucket") < F.col("cross")).cast("int")).where("copies > 0")
    whole = whole.withColumn("epoch", F.explode(F.expr("sequence(0, copies - 1)"))).select("row", *last)
    # Only the rows of the one range: whole rows go through the window, since no key tells repeated rows apart.
    upto = Window.partitionBy(*LEVELS).orderBy("h", "tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = rows.where("bucket = cross").withColumn("upto", F.sum("tokens").over(upto)).where("before + upto <= rest")
    part = part.withColumn("epoch", F.col("full")).select("row", *last)
    return whole.unionByName(part).select("row.*", *taken)
