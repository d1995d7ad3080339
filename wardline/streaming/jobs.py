"""Continuous scans, user history and alert cooldown on Structured Streaming.

The bot counts in processing time; here event time rules. Rows of a micro-batch are put in order of (ts, message_id) for
each key, so a key's share of one micro-batch is held at once; `replay` bounds it. Keyed state is in `state`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructField, StructType, TimestampType

from ..functions.extract import explode_candidates, scan_text
from ..operators import risk
from ..operators.alerts import alert_payload, split_main_quiet, suppress_alerts, with_actions
from ..operators.resolve import direct_invites, lookup_invites, redirect_invites, resolve_urls
from ..operators.risk import WINDOW_S
from ..sources.store import discard, stored
from ..sources.tables import human_messages
from .state import ROCKSDB, stream_alert_suppression, stream_user_history

__all__ = ["stream_alert_suppression", "stream_user_history"]
#: What the sinks hold that a stream of messages reads again.
SUSPICIOUS = "message_id long, user_id long, ts timestamp, base_score int"
OPEN = "alert_key string, message_id long, user_id long, ts timestamp, emitted boolean"
CLOCK = "newest timestamp, oldest_batch long"
#: Rows of a micro-batch of a replay, whatever the table's size.
BATCH_ROWS = 100_000
SAMPLED = "spark.sql.execution.rangeExchange.sampleSizePerPartition"


class Static(NamedTuple):
    """What a stream of messages is joined with: snapshots and lists as tables. With `edits` the lists are those of each message's time:
    it is asked for the edits that there are once for each micro-batch, so that edits may come while messages flow."""

    snapshot: DataFrame
    invites: DataFrame
    domains: DataFrame
    servers: DataFrame
    edits: Callable[[], DataFrame] | None = None


def seconds(n: int) -> Column:
    return F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {n})")


def write_batch(df: DataFrame, path: str, name: str, batch: int, ts: str | None = None) -> None:
    """A micro-batch's rows in a folder of its own under the sink, by date of ts. A batch that is run again takes its own place again."""
    writer = df.write.mode("overwrite")
    if ts:
        writer = df.withColumn("date", F.to_date(ts)).write.mode("overwrite").partitionBy("date")
    writer.parquet(f"{path}/{name}/batch={batch}")


def read_sink(spark: SparkSession, path: str, name: str, schema: str, since: int, before: int) -> DataFrame:
    """What the batches from `since` to before `before` have left in a sink; no other batch is read."""
    paths = [f"{path}/{name}/batch={k}" for k in range(max(0, since), before)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_verdicts(messages: DataFrame, static: Static, folder: str, lateness_s: int = 600, path: str | None = None, alerts: bool = False, mode: str = "active") -> str:
    """Scores a stream of messages over what is there, micro-batch by micro-batch, and gives the folder of its sinks.

    A micro-batch is scored by the batch operators, joined with the static tables, into the sink `verdicts`. The history of its users comes from the
    suspicious messages of the last WINDOW_S seconds, which earlier batches have left in `suspicious`. Messages older than the newest of earlier
    batches by more than lateness_s are not scored: they go to `late`. With `alerts` the verdicts go on through the cooldown: `main` and `quiet` have
    what the two channels get, `events` every action. A sink has a folder for each batch, by date, which a batch that is run again
    writes again; so a stream that ended between two writes and is started again with its `path` doubles and loses nothing.
    """
    spark = messages.sparkSession
    path = path or f"{folder}/verdicts-{uuid.uuid4().hex}"

    def each(rows: DataFrame, batch: int) -> None:
        made: list[DataFrame] = []

        def kept(df: DataFrame) -> DataFrame:
            made.append(stored(df))
            return made[-1]

        clock = read_sink(spark, path, "clock", CLOCK, batch - 1, batch).first()
        newest = clock[0] if clock else None
        rows = kept(human_messages(rows))
        late = F.lit(False) if newest is None else F.coalesce(F.col("ts") < F.lit(newest) - seconds(lateness_s), F.lit(False))
        write_batch(rows.where(late), path, "late", batch)
        scanned = kept(scan_text(rows.where(~late)))
        resolved = kept(resolve_urls(explode_candidates(scanned), static.snapshot))
        direct = direct_invites(scanned)
        found = lookup_invites(direct.unionByName(redirect_invites(resolved, direct)), static.invites)
        if static.edits:
            found, edits = kept(found), static.edits()
            flags = risk.url_flags_as_of(resolved, scanned, edits), risk.invite_flags_as_of(found, scanned, edits)
        else:
            flags = risk.url_flags(resolved, static.domains), risk.invite_flags(found, static.servers)
        scored = kept(risk.base_score(risk.message_flags(scanned, *flags)))
        own = scored.select("message_id", "user_id", "ts", "base_score").where("base_score > 0")
        # No message of this or a later batch is older than what is not late; its users' history goes WINDOW_S further back.
        oldest = own.agg(F.min("ts")).first()[0]
        past = read_sink(spark, path, "suspicious", SUSPICIOUS, clock[1] if clock else 0, batch)
        if oldest is not None:
            past = past.where(F.col("ts") >= F.lit(oldest) - seconds(WINDOW_S))
        verdicts = risk.verdicts(risk.with_history(scored, risk.user_history(past.unionByName(own))))
        if alerts:
            verdicts = kept(verdicts)
        write_batch(verdicts, path, "verdicts", batch, "ts")
        write_batch(own, path, "suspicious", batch)
        if alerts:
            _alert_batch(verdicts, path, batch, mode, kept)
        write_batch(_clock(rows, own, path, batch, newest, clock[1] if clock else 0, lateness_s), path, "clock", batch)
        for table in made:
            discard(table)

    _run(spark, messages.writeStream.foreachBatch(each), f"{path}/state")
    return path


def _clock(rows: DataFrame, own: DataFrame, path: str, batch: int, newest: datetime | None, oldest_batch: int, lateness_s: int) -> DataFrame:
    """The newest time so far, and the first batch whose suspicious messages later ones can still reach: earlier files are not read again."""
    spark = rows.sparkSession
    now = rows.agg(F.greatest(F.max("ts"), F.lit(newest).cast("timestamp"))).first()[0]
    while oldest_batch < batch and now is not None:
        held = read_sink(spark, path, "suspicious", SUSPICIOUS, oldest_batch, oldest_batch + 1).agg(F.max("ts")).first()[0]
        if held is not None and held >= now - timedelta(seconds=lateness_s + WINDOW_S):
            break
        oldest_batch += 1
    return spark.createDataFrame([(now, oldest_batch)], CLOCK)


def _alert_batch(verdicts: DataFrame, path: str, batch: int, mode: str, kept: Callable[[DataFrame], DataFrame]) -> None:
    """The cooldown over micro-batches: each key's last alert and what it has muted so far come from the batch before, in `open`, and go on to the next.

    A row that is older than its key's last alert of an earlier batch is muted by that alert.
    """
    spark = verdicts.sparkSession
    actions = kept(with_actions(verdicts, mode))
    write_batch(actions.select("message_id", "user_id", "ts", "action", "verdict", "reasons", "score"), path, "events", batch, "ts")
    before = read_sink(spark, path, "open", OPEN, batch - 1, batch)
    sent = before.where("emitted").select("alert_key", (F.col("ts") + F.expr("INTERVAL 1 MICROSECOND")).alias("after"))
    new = actions.select("alert_key", "message_id", "user_id", "ts").join(sent, "alert_key", "left").withColumn("ts", F.greatest("ts", "after")).drop("after")
    carried = before.select("alert_key", "message_id", "user_id", "ts", F.lit(False).alias("new"))
    every = kept(carried.unionByName(new.withColumn("new", F.lit(True))))
    told = suppress_alerts(every).join(every.select("alert_key", "message_id", "new"), ["alert_key", "message_id"])
    told = kept(told)
    payload = kept(alert_payload(told.where("new"), actions).join(actions.select("message_id", "ts"), "message_id"))
    for name, part in zip(("main", "quiet"), split_main_quiet(payload), strict=True):
        write_batch(part, path, name, batch, "ts")
    last = told.where("emitted").groupBy("alert_key").agg(F.max("ts").alias("last"))
    still = told.join(last, "alert_key").where(F.col("ts") >= F.col("last"))
    write_batch(still.select("alert_key", "message_id", "user_id", "ts", "emitted"), path, "open", batch)


def quarantine(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scanned and rows with an error that can't."""
    error = F.when(F.col("message_id").isNull(), "no message_id").when(F.col("ts").isNull(), "no ts").when(~F.is_valid_utf8(F.coalesce("content", F.lit(""))), "bad text")
    marked = messages.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def late_apart(messages: DataFrame, folder: str, stateful: Callable[[DataFrame, str], DataFrame], lateness_s: int = 600) -> tuple[DataFrame, DataFrame]:
    """Runs a stateful stream over what is there, and gives its rows and the late ones: none of the stream's rows is lost.

    A stored clock, the newest time of the micro-batches before, parts each micro-batch ahead of the state: rows behind it by lateness_s or more go to
    `late`, with the clock; rows without a time too. The others are the next micro-batch of the stateful stream, whose own watermark
    stays a second behind the clock, so that it drops nothing. A micro-batch that is run again finds its part written and is not split anew.
    """
    spark = messages.sparkSession
    path = f"{folder}/late-{uuid.uuid4().hex}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    done = lambda name, batch: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}-{batch}/_SUCCESS"))
    source = messages.schema

    def each(rows: DataFrame, batch: int) -> None:
        if not done("clock", batch):
            newest = spark.read.schema("newest timestamp").parquet(f"{path}/clock-{batch - 1}").first()[0] if batch else None
            rows = rows.persist()
            behind = F.lit(newest).cast("timestamp") - F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {lateness_s})")
            late = F.col("ts").isNull() | F.coalesce(F.col("ts").cast("timestamp") <= behind, F.lit(False))
            rows.where(~late).write.mode("overwrite").parquet(f"{path}/on-time/batch-{batch}")
            rows.where(late).withColumn("clock", F.lit(newest).cast("timestamp")).write.mode("overwrite").parquet(f"{path}/late/batch-{batch}")
            rows.agg(F.greatest(F.max(F.col("ts").cast("timestamp")), F.lit(newest).cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{path}/clock-{batch}")
            rows.unpersist()
        # All files that are new are one micro-batch.
        stream = spark.readStream.schema(source).option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").option("maxFileAge", "3650d").parquet(f"{path}/on-time")
        _run(spark, stateful(stream, f"{lateness_s + 1} seconds").writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/state")

    _run(spark, messages.writeStream.foreachBatch(each), f"{path}/split")
    out = stateful(spark.readStream.schema(source).parquet(f"{path}/on-time"), f"{lateness_s + 1} seconds").schema
    late = spark.read.schema(StructType([*source.fields, StructField("clock", TimestampType())])).option("recursiveFileLookup", True).parquet(f"{path}/late")
    return spark.read.schema(out).parquet(f"{path}/out"), late


def _run(spark: SparkSession, writer: DataStreamWriter, checkpoint: str) -> None:
    """Runs a query of this session over what is there, its state in RocksDB. (The active session may be that of an earlier stream.)"""
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKSDB)
    try:
        writer.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(key, before)


def replay(table: DataFrame, order: str, folder: str, rows: int = BATCH_ROWS) -> DataFrame:
    """A table as a stream in the order of a column that grows with event time: files of at most `rows` rows, one to a micro-batch.

    The file source takes files by modification time, so that is set in the order of the names, which is that of the rows.
    """
    spark = table.sparkSession
    path = f"{folder}/replay-{uuid.uuid4().hex}"
    # Ranges are 5 % short of a file, and sampled well enough to seldom be more than one: its rest would be a small micro-batch of its own.
    parts = max(1, -(-table.count() * 20 // (19 * rows)))
    before = spark.conf.get(SAMPLED)
    spark.conf.set(SAMPLED, "2500")
    try:
        table.repartitionByRange(parts, order).sortWithinPartitions(order).write.option("maxRecordsPerFile", rows).parquet(path)
    finally:
        spark.conf.set(SAMPLED, before)
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((f.getPath() for f in fs.listStatus(home) if f.getPath().getName().startswith("part-")), key=_place)
    last = fs.getFileStatus(home).getModificationTime()
    for k, file in enumerate(files):
        fs.setTimes(file, last - 1000 * (len(files) - k), -1)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("maxFileAge", f"{len(files) + 7 * 86400}s").option("pathGlobFilter", "part-*").parquet(path)


def _place(path) -> tuple[int, int]:
    """Partition and number of a part file, of part-00012-uuid-c003.snappy.parquet."""
    name = path.getName()
    return int(name.split("-")[1]), int(name.rsplit("-c", 1)[1].split(".")[0])


def run_available(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there, into a table in the folder, and reads it."""
    path = f"{folder}/stream-{uuid.uuid4().hex}"
    _run(stream.sparkSession, stream.writeStream.foreachBatch(each) if each else stream.writeStream.format("parquet").option("path", path), f"{path}-state")
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
