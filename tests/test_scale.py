"""Hot keys of joins, large lists, and users' histories in slices, against plain counts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import lists as L
from wardline.operators.risk import user_history, with_own_history
from wardline.operators.spread import heavy_keys, spread_join
from wardline.plans import queries

T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="module")
def asked(spark):
    """20,000 rows, half of them with one key, and some with none."""
    key = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 101 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string")))
    return spark.range(20_000).select(F.col("id").alias("n"), key.alias("key"))


def test_heavy_keys(asked):
    assert [(k, n) for k, n in heavy_keys(asked, "key", 1000)] == [("hot", 10_000)]
    assert heavy_keys(asked.where("key IS NULL"), "key") == []


def test_spread_join_is_the_join(spark, asked):
    right = spark.range(0, 700, 3).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v")).union(spark.sql("SELECT 'hot', 9L UNION ALL SELECT 'hot', 8L"))
    got = spread_join(asked, right, "key", ["n"], 500)
    want = asked.join(right, "key", "left")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() > 29_000


def test_a_hot_key_is_spread_over_tasks(spark, asked):
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", -1), ("spark.sql.adaptive.enabled", False), ("spark.sql.shuffle.partitions", 16)):
        spark.conf.set(name, value)
    try:
        out = spread_join(asked, spark.createDataFrame([("hot", 1), ("k3", 2)], "key string, v int"), "key", ["n"], 500).groupBy(F.spark_partition_id()).count()
        sizes = [r[1] for r in out.collect()]
        assert max(sizes) < 3000 and len(sizes) > 8
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", 4)


@pytest.mark.parametrize("sent", [L.SENT, 10])
def test_a_list_of_a_million_entries(spark, sent):
    """Both forms, with hashes sent to tasks and without."""
    entries = spark.range(1_000_000).select(F.concat(F.lit("e"), F.col("id").cast("string"), F.lit(".example.com")).alias("domain"))
    names = ["e7.example.com", "a.b.e999999.example.com", "xe7.example.com", "example.com", "e1000000.example.com", "com", "", None, "E12.example.com", "e12.example.com.evil.net", "e7.example.com"]
    rows = spark.createDataFrame(list(enumerate(names)), "n long, domain string")
    on, off = (sorted(r.n for r in f(rows, entries, sent=sent).collect()) for f in (L.domains_on, L.domains_off))
    assert on == [0, 1, 8, 10] and off == [2, 3, 4, 5, 6, 7, 9]
    empty = entries.limit(0)
    assert L.domains_on(rows, empty, sent=sent).count() == 0 and L.domains_off(rows, empty, sent=sent).count() == len(names)


@pytest.mark.parametrize("slice_s", [600, 3600, 10**9])
def test_history_in_slices(spark, slice_s):
    """A user of half of all rows, ties of time, and rows on the edges of slices; no slice holds more than its time and the one before."""
    rng = random.Random(slice_s)
    rows = [(2**60 + n, rng.choice([7, 7, 7, 2**59 + 1, -5]), T0 + datetime.timedelta(seconds=rng.choice([600 * rng.randrange(40), rng.randrange(24_000)]), microseconds=rng.choice([0, 0, 1, 999_999])), 10) for n in range(900)]
    rows += [(1, None, T0, 10), (2, 7, None, 10), (3, 7, T0, 0)]
    got = {r.message_id: r.earlier for r in user_history(spark.createDataFrame(rows, "message_id long, user_id long, ts timestamp, base_score int").repartition(3), slice_s).collect()}
    fit = [r for r in rows if r[1] is not None and r[2] is not None and r[3]]
    want = {m: sum(u == v and datetime.timedelta(0) <= t - s <= datetime.timedelta(seconds=600) and (s < t or k < m) for k, v, s, _ in fit) for m, u, t, _ in fit}
    assert got == want


def test_history_keeps_the_columns_of_its_rows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, None]), None if i % 17 == 0 else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randint(0, 9000)), rng.choice([0, 10]), f"text {i}") for i in range(400)]
    scored = spark.createDataFrame(rows, "message_id long, user_id long, ts timestamp, base_score int, content string").repartition(3)
    known = {r.message_id: r.earlier for r in user_history(scored).collect()}
    got = with_own_history(scored).select("message_id", "user_id", "ts", "base_score", "content", "earlier").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*r, known.get(r[0], 0))) for r in rows) and any(known.values())


def test_a_scan_takes_each_text_once(spark):
    s = queries.scan(spark, "/root/testdata/sf0.001")
    texts = [r.content for r in s["texts"].collect()]
    messages = s["messages"].join(s["texts"].select(F.col("message_id").alias("text_id"), F.col("content").alias("text")), "text_id").collect()
    assert len(texts) == len(set(texts)) == len({r.content for r in messages}) < len(messages)
    assert all(r.content == r.text for r in messages)
