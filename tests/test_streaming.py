"""Streams in many micro-batches: bounded, in order, and equal to the batch operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from wardline.functions.extract import explode_candidates, scan_text
from wardline.operators import risk
from wardline.operators.alerts import suppress_alerts
from wardline.operators.resolve import direct_invites, inspected_snapshot, lookup_invites, resolve_urls
from wardline.operators.risk import WINDOW_S
from wardline.plans import queries as Q
from wardline.sources.tables import human_messages
from wardline.streaming import jobs


@pytest.fixture(scope="module")
def actions(spark):
    ts = F.timestamp_seconds(F.col("id") * 7 + 1_700_000_000)
    return spark.range(500).select(F.col("id").alias("message_id"), (F.col("id") % 11).alias("user_id"), ts.alias("ts"), F.concat(F.lit("key"), (F.col("id") % 11 % 3).cast("string")).alias("alert_key"))


def micro_batches(stream, tmp_path):
    sizes = []
    query = stream.writeStream.foreachBatch(lambda df, _: sizes.append(tuple(df.agg(F.count("*"), F.min("message_id"), F.max("message_id")).first()))).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    return sizes


def test_replay_is_bounded_and_in_order(actions, tmp_path):
    got = micro_batches(jobs.replay(actions.orderBy(F.desc("message_id")), "message_id", str(tmp_path / "in"), 60), tmp_path / "state")
    assert sum(n for n, *_ in got) == 500 and len(got) > 8 and max(n for n, *_ in got) <= 60
    assert all(a[2] < b[1] for a, b in zip(got, got[1:]))


def test_registered_streams_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q.X, "shared_folder", lambda spark: str(tmp_path / "in"))
    monkeypatch.setattr(jobs.replay, "__defaults__", (400,))
    got = micro_batches(Q._stream(spark, "/root/testdata/sf0.001").withColumnRenamed("event_id", "message_id"), tmp_path / "state")
    assert sum(n for n, *_ in got) == 1000 and max(n for n, *_ in got) <= 400


def test_cooldown_over_micro_batches(actions, tmp_path):
    columns = ["alert_key", "message_id", "user_id", "emitted", "suppressed_count", "user_count", "note"]
    out = jobs.run_available(jobs.stream_alert_suppression(jobs.replay(actions, "message_id", str(tmp_path), 120)), str(tmp_path))
    assert sorted(map(tuple, out.select(columns).collect())) == sorted(map(tuple, suppress_alerts(actions).select(columns).collect()))


def test_history_over_micro_batches(actions, tmp_path):
    out = jobs.run_available(jobs.stream_user_history(jobs.replay(actions, "message_id", str(tmp_path), 120)), str(tmp_path))
    got = {r.message_id: (r.earlier, r.late) for r in out.collect()}
    assert got == {i: (sum(i % 11 == j % 11 and (i - j) * 7 <= WINDOW_S for j in range(i)), False) for i in range(500)}


T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)


def static(spark):
    snapshot = spark.createDataFrame([("https://none.example", "HEAD", 405, None, 0, None, None, None, T0)], "request_url string, method string, status int, final_url string, history_len int, content_type string, body binary, error string, fetched_at timestamp")
    invites = spark.createDataFrame([("fine", 456, True, None)], "code string, guild_id long, resolved boolean, error string")
    lists = spark.createDataFrame([("blocklist", "bad.example.net")], "list_name string, domain string"), spark.createDataFrame([("allowlist", 456)], "list_name string, server_id long")
    return jobs.Static(jobs.stored(inspected_snapshot(snapshot)), invites, *lists)


TEXTS = ["https://bad.example.net/x", "https://discord.gg/fine", "https://a.example.com", "hello", "https://discord.gg/other"]


@pytest.fixture
def messages(spark):
    rows = [(i, T0 + datetime.timedelta(seconds=40 * i), 1, i % 3, TEXTS[i % 5], T0, False) for i in range(60)]
    return spark.createDataFrame(rows, "message_id long, ts timestamp, guild_id long, user_id long, content string, account_created_at timestamp, author_is_bot boolean")


def test_stream_verdicts_equal_batch(spark, messages, tmp_path):
    """Over several micro-batches, each of several shuffled partitions: the history crosses batches."""
    fixed = static(spark)
    path = jobs.stream_verdicts(jobs.replay(messages, "message_id", str(tmp_path), 25), fixed, str(tmp_path))
    assert len(list((tmp_path / path.rsplit("/", 1)[1] / "verdicts").glob("batch=*"))) == 3
    scanned = scan_text(human_messages(messages))
    resolved = resolve_urls(explode_candidates(scanned), fixed.snapshot)
    found = lookup_invites(direct_invites(scanned), fixed.invites)
    want = risk.score_messages(scanned, resolved, found, fixed.domains, fixed.servers)
    columns = ["message_id", "verdict", "score", "reasons", "matched_domains", "matched_server_ids", "alert_level"]
    got = spark.read.parquet(f"{path}/verdicts").select(columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(columns).collect())) and got.where("array_contains(reasons, 'repeated suspicious activity from the same user')").count() > 5
    assert spark.read.parquet(f"{path}/late").count() == 0


def edits(spark):
    """bad.example.net is blocked until a third of the messages have come, and again for the last third; 456 is allowed all the time but a minute."""
    at = lambda n: T0 + datetime.timedelta(seconds=40 * n)
    rows = [(1, at(-9), "domain", "blocklist", "add", "bad.example.net"), (2, at(-9), "server", "allowlist", "add", "456"), (3, at(20), "domain", "blocklist", "remove", "bad.example.net"), (4, at(26), "server", "blocklist", "add", "456"), (5, at(27), "server", "allowlist", "add", "456"), (6, at(40), "domain", "blocklist", "add", "BAD.example.net/")]
    return spark.createDataFrame(rows, "seq long, ts timestamp, entry_type string, list_name string, action string, value string")


def test_killed_stream_gives_the_batch_result(spark, messages, tmp_path, monkeypatch):
    """The stream ends between two writes of its second micro-batch and is started again: verdicts, alerts and events are those of one batch."""
    from wardline.operators.alerts import alert_payload, split_main_quiet, with_actions

    table = jobs.stored(edits(spark))
    fixed = static(spark)._replace(edits=lambda: table)
    source, path, whole = jobs.replay(messages, "message_id", str(tmp_path), 20), str(tmp_path / "sinks"), jobs.write_batch
    failed = []

    def fails(df, path, name, batch, ts=None):
        if (name, batch) == ("quiet", 1) and not failed:
            failed.append(name)
            raise RuntimeError("killed")
        whole(df, path, name, batch, ts)

    monkeypatch.setattr(jobs, "write_batch", fails)
    with pytest.raises(Exception, match="killed"):
        jobs.stream_verdicts(source, fixed, "", path=path, alerts=True)
    jobs.stream_verdicts(source, fixed, "", path=path, alerts=True)
    scanned = jobs.stored(scan_text(human_messages(messages)))
    resolved = jobs.stored(resolve_urls(explode_candidates(scanned), fixed.snapshot))
    found = jobs.stored(lookup_invites(direct_invites(scanned), fixed.invites))
    want = jobs.stored(risk.score_messages_as_of(scanned, resolved, found, table))
    columns = ["message_id", "verdict", "score", "reasons", "matched_domains", "matched_server_ids", "alert_level"]
    read = lambda name, df, columns: (sorted(map(repr, spark.read.parquet(f"{path}/{name}").select(columns).collect())), sorted(map(repr, df.select(columns).collect())))
    got, all_ = read("verdicts", want, columns)
    assert got == all_ and len({r.verdict for r in want.where("content LIKE '%bad%'").collect()}) == 2 and len({r.verdict for r in want.where("content LIKE '%fine%'").collect()}) == 2
    actions = jobs.stored(with_actions(want))
    for name, df in zip(("main", "quiet"), split_main_quiet(alert_payload(suppress_alerts(actions), actions)), strict=True):
        got, all_ = read(name, df, ["alert_key", "message_id", "title", "note", "score"])
        assert got == all_ and got and (name == "quiet" or any("Suppressed" in r for r in got))
    got, all_ = read("events", actions, ["message_id", "action", "score"])
    assert got == all_ and failed


def test_late_messages_go_to_their_own_table(spark, messages, tmp_path):
    late = F.col("message_id").isin(50, 57)
    moved = messages.withColumn("place", F.col("message_id")).withColumn("ts", F.when(late, F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ts")))
    path = jobs.stream_verdicts(jobs.replay(moved, "place", str(tmp_path), 25).drop("place"), static(spark), str(tmp_path))
    assert {r.message_id for r in spark.read.parquet(f"{path}/late").collect()} == {50, 57}
    assert {r.message_id for r in spark.read.parquet(f"{path}/verdicts").collect()} == set(range(60)) - {50, 57}


def test_stragglers_ahead_of_the_watermark(spark, tmp_path):
    """A row that comes after newer ones of its user is counted against what has come by then."""
    order = [0, 100, 300, 200, 400, 250, 900, 700]
    ts = F.timestamp_seconds(F.element_at(F.array(*map(F.lit, order)), (F.col("id") + 1).cast("int")) + 1_700_000_000)
    rows = spark.range(len(order)).select(F.col("id").alias("message_id"), F.lit(7).cast("long").alias("user_id"), ts.alias("ts"))
    out = jobs.run_available(jobs.stream_user_history(jobs.replay(rows, "message_id", str(tmp_path), 1)), str(tmp_path))
    got = {r.message_id: (r.earlier, r.late) for r in out.collect()}
    assert got == {i: (sum(0 <= at - b <= WINDOW_S for b in order[:i]), any(b > at for b in order[:i])) for i, at in enumerate(order)}


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, T0, "x"), (None, T0, "x"), (2, None, "x"), (3, T0, None)], "message_id long, ts timestamp, content string")
    good, bad = jobs.quarantine(rows)
    assert [r.message_id for r in good.orderBy("message_id").collect()] == [1, 3] and sorted(r.error for r in bad.collect()) == ["no message_id", "no ts"]
