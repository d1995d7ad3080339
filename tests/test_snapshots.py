"""The incremental table of latest rows against a plain walk of all deliveries."""

import datetime
import random

from pyspark.sql import functions as F

from wardline.sources.snapshots import bucketed, invite_table, latest_rows, update_latest
from wardline.sources.tables import INVITES, latest_snapshot

T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)
KINDS = "url string, method string, status int, fetched_at timestamp"


def deliveries(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        rows = [(f"u{rng.randrange(30)}", rng.choice(["HEAD", "GET"]), rng.randrange(600), T0 + datetime.timedelta(seconds=rng.randrange(10_000))) for _ in range(120)]
        rows += [(None, "GET", 1, T0), ("u1", None, 1, T0), ("u2", "GET", 7, None), ("timeless", "GET", 8, None)]
        out.append(rows)
    return out


def test_latest_of_all_deliveries(spark):
    parts, table, want = deliveries(3), None, {}
    for rows in parts:
        table = update_latest(table, spark.createDataFrame(rows, KINDS), "url", "method", buckets=4)
        for url, method, status, at in rows:
            if url is not None and method is not None:
                old = want.get((url, method))
                if old is None or (at is not None and (old[1] is None or at >= old[1])):
                    want[url, method] = (status, at)
        got = {(r.url, r.method): (r.status, r.fetched_at) for r in latest_rows(table, "url").collect()}
        assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    every = spark.createDataFrame([r for p in parts for r in p if r[0] and r[1]], KINDS)
    assert got == {(r.url, r.method): (r.status, r.fetched_at) for r in latest_snapshot(every, ["url", "method"]).collect()} and len(got) > 50


def test_a_table_is_not_moved_by_joins_and_updates(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        table = update_latest(None, spark.createDataFrame(deliveries(1)[0], KINDS), "url", "method", buckets=4)
        asked = spark.range(1000).select(F.concat(F.lit("u"), (F.col("id") % 40).cast("string")).alias("url"), "id")
        plan = asked.join(table, "url", "left")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert asked.join(table, "url", "left").count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookups_and_their_errors(spark, tmp_path):
    from wardline.operators.resolve import lookup_invites

    def row(code, guild, resolved, error, hour):
        return (code, guild, None, None, None, None, None, None, resolved, error, T0 + datetime.timedelta(hours=hour))

    parts = [[row("a", 2**60 + 1, True, None, 0), row("b", None, False, "rate limited", 0), row("c", 5, True, None, 3)], [row("a", None, False, "gone", 1), row("b", 7, True, None, 1), row("c", None, False, "old error", 2)]]
    paths = []
    for k, rows in enumerate(parts):
        paths.append(str(tmp_path / f"d{k}"))
        spark.createDataFrame(rows, INVITES).write.parquet(paths[-1])
    snapshot = latest_rows(invite_table(spark, paths, 2), "code").select("code", "guild_id", "resolved", "error")
    asked = spark.createDataFrame([(1, 0, "direct", "u", c) for c in "abcd"], "message_id long, pos int, kind string, url string, code string")
    got = {r.code: (r.guild_id, r.resolved, r.error) for r in lookup_invites(asked, snapshot).collect()}
    assert got == {"a": (None, False, "gone"), "b": (7, True, None), "c": (5, True, None), "d": (None, False, "invite is invalid or expired")}


def test_empty_deliveries(spark):
    none = spark.createDataFrame([], KINDS)
    table = update_latest(update_latest(None, none, "url", "method", buckets=2), none, "url", "method", buckets=2)
    assert table.count() == 0 and bucketed(none, "url", 2).count() == 0
