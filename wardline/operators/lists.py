"""Allow and block lists: edits, state, as-of state, and matches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import host_suffixes, normalize_domain

# Scores from which a message is reviewed.
HIGH, LOW = 50, 10


LISTS = ("allowlist", "blocklist")


def normalized_value() -> Column:
    """value of ops made regular; null if it is no domain or id."""
    return F.when(F.col("entry_type") == "domain", normalize_domain(F.col("value"))).otherwise(F.trim("value").try_cast("bigint").cast("string"))


def normalized_ops(ops: DataFrame) -> DataFrame:
    """ops (seq, ts, entry_type, list_name, action, value) with value made regular; null if it is no domain or id."""
    return ops.withColumn("value", normalized_value())


def rejected_ops(ops: DataFrame) -> DataFrame:
    """Ops whose value is no domain or id, with the value as given."""
    return normalized_ops(ops.withColumn("given", F.col("value"))).where("value IS NULL")


def _effects(ops: DataFrame) -> DataFrame:
    """Each add puts a value on its list and takes it off the other; a remove touches its own list only."""
    other = F.when(F.col("list_name") == "allowlist", "blocklist").otherwise("allowlist")
    own = F.struct(F.col("list_name").alias("list_name"), (F.col("action") == "add").alias("present"))
    both = F.array(own, F.struct(other.alias("list_name"), F.lit(False).alias("present")))
    rows = normalized_ops(ops).where("value IS NOT NULL")
    rows = rows.select("seq", "ts", "entry_type", "value", F.explode(F.when(F.col("action") == "add", both).otherwise(F.array(own))).alias("e"))
    return rows.select("seq", "ts", "entry_type", "value", "e.*")


def apply_list_ops(ops: DataFrame) -> DataFrame:
    """entry_type, list_name, value of what is on the lists after all ops."""
    last = _effects(ops).groupBy("entry_type", "list_name", "value").agg(F.max_by("present", "seq").alias("present"))
    return last.where("present").drop("present")


#: Rows of a value that one window takes, if they are even over time: the time span has as many parts as the commonest value needs.
PART_ROWS = 50_000


def lists_as_of(rows: DataFrame, ops: DataFrame, value: str, ts: str, entry_type: str, part_rows: int = PART_ROWS) -> DataFrame:
    """rows with list_name for each list that holds their value at their time, null if none does; an edit counts from its own second on.

    Rows and edits go through one window in order of time (ops are in order of seq and time alike), so the work grows with both, not with
    their product. The window is cut by value and by part of the time span, since one value may have most rows; what a list holds where a
    part begins comes with a row of its own. A row without value or time is on no list.
    """
    edits = _effects(ops).where(F.col("entry_type") == entry_type).select("value", "list_name", F.unix_micros("ts").alias("us"), "seq", "present")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = rows.agg(F.min(us), F.max(us)).first()
    most = rows.groupBy(F.col(value).cast("string")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // part_rows) or 1
    low, width = low or 0, ((high or 0) - (low or 0)) // parts + 1
    part = F.greatest(F.lit(-1), F.least(F.lit(parts), F.floor((F.col("us") - low) / width))).cast("int")
    edits = edits.withColumn("part", part).where(F.col("part") < parts)
    ends = edits.groupBy("value", "list_name", "part").agg(F.max_by("present", F.struct("us", "seq")).alias("present"))
    after = F.lead("part").over(Window.partitionBy("value", "list_name").orderBy("part"))  # at most a row for each part
    carried = ends.withColumn("to", F.coalesce(after, F.lit(parts - 1))).where("present AND part < to")
    carried = carried.select("value", "list_name", F.explode(F.expr("sequence(part + 1, to)")).alias("part"), F.lit(None).cast("bigint").alias("us"), F.lit(None).cast("bigint").alias("seq"), F.lit(True).alias("present"))
    changes = edits.where("part >= 0").select("value", "list_name", "part", "us", "seq", "present").unionByName(carried)
    nothing = {"list_name": F.lit(None).cast("string"), "seq": F.lit(None).cast("bigint"), "present": F.lit(None).cast("boolean")}
    asked = rows.select(F.struct("*").alias("row"), F.col(value).cast("string").alias("value"), us.alias("us")).withColumns(nothing)
    asked = asked.withColumn("part", part).withColumn("kind", F.lit(1))
    both = asked.unionByName(changes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    upto = Window.partitionBy("value", "part").orderBy(F.col("us").asc_nulls_first(), "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = [F.when(F.coalesce(F.last(F.when(F.col("list_name") == name, F.col("present")), True).over(upto), F.lit(False)), F.lit(name)) for name in LISTS]
    known = F.col("value").isNotNull() & F.col("us").isNotNull()
    names = F.filter(F.array(*held), lambda x: x.isNotNull())
    found = both.withColumn("names", names).where("kind = 1").withColumn("names", F.when(known, F.col("names")))
    return found.select("row.*", F.explode_outer("names").alias("list_name"))


def domain_matches(rows: DataFrame, domain_list: DataFrame, domain: str = "domain") -> DataFrame:
    """rows with list_name for each list that holds the domain or a parent: an equi-join on suffixes, not a pairwise test."""
    keyed = rows.withColumn("__suffix", F.explode(host_suffixes(F.col(domain))))
    hit = keyed.join(domain_list.select("list_name", F.col("domain").alias("__suffix")), "__suffix").drop("__suffix")
    return hit.distinct()


#: A list of up to so many entries is sent to tasks as sorted hashes, of 8 bytes each.
SENT = 1 << 22


def _perhaps_listed(entries: DataFrame, sent: int) -> Callable[[Column], Column] | None:
    """A test of a domain that is false only if neither it nor a parent is an entry; none for a list of more than `sent` entries."""
    if entries.count() > sent:
        return None
    hashes = np.sort(np.array([r[0] for r in entries.select(F.xxhash64("domain")).collect()], np.int64))
    shared = entries.sparkSession.sparkContext.broadcast(hashes)

    @F.pandas_udf("boolean")
    def any_known(suffixes: pd.Series) -> pd.Series:
        known = shared.value
        size = suffixes.map(len).to_numpy()
        flat = np.concatenate([np.zeros(0, np.int64), *suffixes])
        hit = known[np.minimum(np.searchsorted(known, flat), len(known) - 1)] == flat if len(known) else np.zeros(len(flat), bool)
        found = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(size)
        return pd.Series(found[ends] > found[ends - size])

    return lambda domain: any_known(F.coalesce(F.transform(host_suffixes(domain), lambda s: F.xxhash64(s)), F.array().cast("array<bigint>")))


def listed_domains(rows: DataFrame, domain_list: DataFrame, domain: str = "domain", sent: int = SENT) -> DataFrame:
    """The distinct domains of rows that are entries of the list, or below one.

    Hashes of the entries, where they are few enough to send, drop nearly all other domains before any is moved; the join by suffix then decides, whatever
    the list's size.
    """
    entries = domain_list.select(F.col("domain").alias("domain")).where("domain IS NOT NULL").distinct()
    names = rows.select(F.col(domain).alias("name")).where("name IS NOT NULL")
    perhaps = _perhaps_listed(entries, sent)
    names = (names.where(perhaps(F.col("name"))) if perhaps else names).distinct()
    below = names.withColumn("suffix", F.explode(host_suffixes(F.col("name"))))
    return below.join(entries.withColumnRenamed("domain", "suffix"), "suffix", "left_semi").select(F.col("name").alias(domain)).distinct()


def domains_on(rows: DataFrame, domain_list: DataFrame, domain: str = "domain", sent: int = SENT) -> DataFrame:
    """The rows whose domain, or a parent of it, is on the list."""
    return rows.join(listed_domains(rows, domain_list, domain, sent), domain, "left_semi")


def domains_off(rows: DataFrame, domain_list: DataFrame, domain: str = "domain", sent: int = SENT) -> DataFrame:
    """The other rows, those without a domain among them."""
    return rows.join(listed_domains(rows, domain_list, domain, sent), domain, "left_anti")


def server_matches(rows: DataFrame, server_list: DataFrame, server: str = "guild_id") -> DataFrame:
    return rows.join(server_list.select("list_name", F.col("server_id").alias(server)), server)


def list_report(entries: DataFrame, scope_size: int = 20) -> DataFrame:
    """The first entries of each list: domains by name, servers by number."""
    order = [F.when(F.col("entry_type") == "server", F.col("value").try_cast("bigint")), F.col("value")]
    rank = F.row_number().over(Window.partitionBy("entry_type", "list_name").orderBy(*order))
    return entries.withColumn("rank", rank).where(F.col("rank") <= scope_size)


def status_summary(entries: DataFrame, events: DataFrame, alerts: DataFrame, config: DataFrame) -> DataFrame:
    """name, value: list sizes, recent events, alert keys, thresholds, mode and punishment, all as text. config: the one row of runtime_config."""
    text = lambda c: c.cast("string").alias("value")
    sizes = entries.groupBy(F.concat_ws("_", "entry_type", "list_name").alias("name")).agg(text(F.count(F.lit(1))))
    recent = events.agg(text(F.least(F.lit(25).cast("bigint"), F.count(F.lit(1))))).select(F.lit("recent_events").alias("name"), "value")
    keys = alerts.agg(text(F.countDistinct("alert_key"))).select(F.lit("alert_keys").alias("name"), "value")
    channel = F.coalesce(F.concat(F.lit("<#"), F.col("mod_log_channel_id").cast("string"), F.lit(">")), F.lit("not configured"))
    said = {
        "scanning": F.lit("enabled"),
        "mode": F.col("mode"),
        "mod_log_channel": channel,
        "thresholds": F.lit(f"{LOW}/{HIGH}"),
        "punishment": F.col("block_punishment"),
        "timeout_minutes": F.col("action_timeout_minutes").cast("string"),
        "appeal": F.when(F.col("appeal_form_url").isNotNull(), "set").otherwise("not set"),
    }
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in said.items())))
    return sizes.unionByName(recent).unionByName(keys).unionByName(config.select(rows.alias("r")).select("r.*"))
