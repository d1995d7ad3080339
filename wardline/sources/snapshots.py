"""Snapshots that grow by deliveries: a table of the latest rows, bucketed by key.

The table has a row for each key, whose `slots` map holds the latest row of each slot (of a URL: its HEAD and its GET). A delivery is
made one row a key first; then it alone is moved to the buckets in which the table lies, and the history is never ranked again. A
join with the table on its key doesn't move the table either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import shared_folder
from .tables import FETCHES, INVITES, latest_snapshot

BUCKETS = 64


def bucketed(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """df as a table of its own in the shared folder, in buckets of the key."""
    spark = df.sparkSession
    name = f"snapshot_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def delivered(rows: DataFrame, key: str, slot: str | None, at: str = "fetched_at") -> DataFrame:
    """key, slots: the latest row of each slot. Of rows of one time one is taken, the same at each run."""
    named = rows.withColumn("slot", F.col(slot) if slot else F.lit("-")).where(f"{key} IS NOT NULL AND slot IS NOT NULL")
    rest = [c for c in rows.columns if c != key]
    last = latest_snapshot(named.select(key, "slot", F.struct(F.col(at).alias("at"), F.xxhash64(*rest).alias("tie"), F.struct(*rest).alias("row")).alias("r")).select(key, "slot", F.col("r.at").alias("at"), "r"), [key, "slot"], "at")
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "r"))).alias("slots"))


def update_latest(table: DataFrame | None, rows: DataFrame, key: str, slot: str | None = None, at: str = "fetched_at", buckets: int = BUCKETS) -> DataFrame:
    """The table after a delivery, as a new table: a slot changes where the delivery has a later row; a late delivery of older rows changes nothing."""
    new = delivered(rows, key, slot, at)
    if table is None:
        return bucketed(new, key, buckets)
    later = lambda a, b: F.struct(b["at"].isNotNull(), b["at"], b["tie"]) > F.struct(a["at"].isNotNull(), a["at"], a["tie"])
    pick = lambda _, a, b: F.when(a.isNull() | (b.isNotNull() & later(a, b)), b).otherwise(a)
    nothing = F.lit(None).cast(new.schema["slots"].dataType)
    both = table.withColumnRenamed("slots", "held").join(new.withColumnRenamed("slots", "come"), key, "full")
    merged = F.when(F.col("held").isNull(), F.col("come")).when(F.col("come").isNull(), F.col("held")).otherwise(F.map_zip_with("held", "come", pick))
    return bucketed(both.select(key, F.coalesce(merged, nothing).alias("slots")), key, buckets)


def latest_rows(table: DataFrame, key: str) -> DataFrame:
    """The rows of all slots, as they were delivered."""
    return table.select(key, F.explode(F.map_values("slots")).alias("r")).select(key, "r.row.*")


def fetch_table(spark: SparkSession, paths: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The latest crawl outcomes out of deliveries of fetch rows, in order of their coming."""
    table = None
    for path in paths:
        table = update_latest(table, spark.read.schema(FETCHES).parquet(path), "request_url", "method", buckets=buckets)
    return table


def invite_table(spark: SparkSession, paths: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The latest invite rows, with what a lookup's error left, out of deliveries."""
    table = None
    for path in paths:
        table = update_latest(table, spark.read.schema(INVITES).parquet(path), "code", buckets=buckets)
    return table
