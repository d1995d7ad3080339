"""The cooldown of hot keys in slices, and with keyed state, against a plain walk of each key."""

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wardline.operators.cooldown import COOLDOWN, entry_times, last_alerts, slice_map, sliced, suppress_alerts
from wardline.streaming import jobs
from wardline.streaming.state import Cooldown, History

T0 = datetime.datetime(2024, 5, 1, 12, 0, 0)
KINDS = "alert_key string, message_id long, user_id long, ts timestamp"
COLUMNS = ["alert_key", "message_id", "user_id", "ts", "emitted", "suppressed_count", "user_count", "note"]


def walk(rows):
    """Each key's rows in order, one by one."""
    out, state = [], {}
    for key, message, user, ts in sorted(rows, key=lambda r: (r[0], r[3], r[1], r[2] is not None, r[2] or 0)):
        last, muted, users = state.get(key, (None, 0, set()))
        if last is None or (ts - last).total_seconds() >= 300:
            n, told = muted, len(users | {user})
            note = f"Suppressed {n} similar events in the last 5 minutes across {told} user(s)." if n else ""
            out.append((key, message, user, ts, True, n, told, note))
            state[key] = (ts, 0, {user})
        else:
            users = users | {user}
            out.append((key, message, user, ts, False, muted + 1, len(users), ""))
            state[key] = (last, muted + 1, users)
    return out


def events(seed):
    """Keys of very different sizes, one of half of all rows; ids of 19 digits, negative and null users, ties, and long silences."""
    rng = random.Random(seed)
    rows, n = [], 0
    for key, size in (("hot", 1500), ("dense", 300), ("one", 1), ("sparse", 60), *((f"k{i}", rng.randint(1, 30)) for i in range(40))):
        at = 0.0
        for _ in range(size):
            at += {"dense": rng.choice([0, 0.000001, 0.5]), "sparse": rng.choice([299, 300, 301, 5000])}.get(key, rng.choice([0, 1, 7, 40, 120, 299.999999, 300, 2000]))
            rows.append((key, 2**60 + n, rng.choice([None, 1185921234567890123, 1185921234567890124, -(2**60) - 1, n]), T0 + datetime.timedelta(microseconds=round(at * 1e6))))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "slice_rows"), [(1, 20), (2, 100), (3, 50_000)])
def test_slices_equal_the_walk(spark, seed, slice_rows):
    rows = events(seed)
    got = suppress_alerts(spark.createDataFrame(rows, KINDS).repartition(5), slice_rows).select(COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(walk(rows), key=repr)


def test_slices_stay_whole_where_the_join_with_entries_turns_into_a_broadcast(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # tables this small have several map tasks only so
    try:
        rows = events(4)
        got = suppress_alerts(spark.createDataFrame(rows, KINDS).repartition(7), 20).select(COLUMNS).collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, got), key=repr) == sorted(walk(rows), key=repr)


def test_a_hot_key_runs_in_many_slices(spark):
    rows = spark.createDataFrame(events(1), KINDS).select("alert_key", "message_id", "user_id", F.unix_micros("ts").alias("us"))
    cut = sliced(rows, 50)
    sizes = {(r.alert_key, r.slice): r.n for r in cut.groupBy("alert_key", "slice").agg(F.count("*").alias("n"), F.floor(F.min("us") / COOLDOWN)).collect()}
    assert sum(k == "hot" for k, _ in sizes) > 20 and max(n for (k, _), n in sizes.items() if k == "hot") < 150
    assert {s for k, s in sizes if k == "one"} == {0}
    assert entry_times(cut).where("alert_key = 'hot' AND entry IS NULL").count() == 1


def test_maps_of_slices():
    rng = np.random.default_rng(0)
    for _ in range(200):
        at = np.sort(rng.integers(0, rng.choice([2, 6, 40]) * COOLDOWN, rng.integers(1, 60))) + 7 * COOLDOWN
        last = last_alerts(at)
        until, to = slice_map(at)
        for mute in at[0] // COOLDOWN * COOLDOWN + rng.integers(-COOLDOWN, COOLDOWN, 20):
            here, seen = None, mute
            for t in at.tolist():
                if t >= seen:
                    here, seen = t, t + COOLDOWN
            k = int(np.searchsorted(until, mute))
            assert (int(to[k]) if k < len(until) else None) == here
        assert last[-1] == at[-1]


def test_null_keys_and_times(spark):
    rows = [("a", 1, 2**60 + 1, T0), (None, 2, 5, T0), ("a", 3, None, None), ("a", 4, None, T0), ("a", 5, 2**60 + 3, T0)]
    got = {r.message_id: (r.user_id, r.emitted, r.user_count, r.note) for r in suppress_alerts(spark.createDataFrame(rows, KINDS).coalesce(1)).collect()}
    assert got == {1: (2**60 + 1, True, 1, ""), 2: (5, False, 0, "no time"), 3: (None, False, 0, "no time"), 4: (None, False, 2, ""), 5: (2**60 + 3, False, 3, "")}
    assert suppress_alerts(spark.createDataFrame([], KINDS)).count() == 0


def replayed(spark, rows, folder, batch):
    """The rows as a stream, `batch` of them a micro-batch, in the order given."""
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place long, " + KINDS)
    return jobs.replay(table, "place", folder, batch).drop("place")


def test_state_equals_the_walk(spark, tmp_path):
    rows = sorted((r for r in events(4) if r[0] != "hot"), key=lambda r: (r[3], r[1]))
    out = jobs.run_available(jobs.stream_alert_suppression(replayed(spark, rows, str(tmp_path), 200), "3650 days"), str(tmp_path))
    got = [tuple(r) for r in out.select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(walk(rows), key=repr)
    assert any(r[2] is None for r in got) and all(r[1] >= 2**60 for r in got)


def test_late_rows_are_kept_apart(spark, tmp_path):
    """Micro-batches out of order: what the state does not take is in `late`, with the clock, and nothing is lost."""
    rng = random.Random(8)
    rows = [("k", 2**60 + i, 2**61 + i % 3, T0 + datetime.timedelta(seconds=10 * i)) for i in range(400)]
    batches = [rows[i : i + 50] for i in range(0, 400, 50)]
    rng.shuffle(batches)
    sent = [r for b in batches for r in b] + [("k", 1, 7, None)]
    source = replayed(spark, sent, str(tmp_path), 50)
    history, late = jobs.late_apart(source, str(tmp_path), jobs.stream_user_history, 600)
    got, gone = {r.message_id: (r.user_id, r.earlier) for r in history.collect()}, {r.message_id: r for r in late.collect()}
    assert not set(got) & set(gone) and {*got, *gone} == {r[1] for r in sent} and len(gone) > 50
    newest, want, taken = None, {}, []
    for k in range(0, len(sent), 50):
        own = sent[k : k + 50]
        on_time = [r for r in own if r[3] is not None and (newest is None or r[3] > newest - datetime.timedelta(seconds=600))]
        for r in sorted(on_time, key=lambda r: (r[3], r[1])):
            want[r[1]] = (r[2], sum(u == r[2] and datetime.timedelta(0) <= r[3] - t <= datetime.timedelta(seconds=600) for u, t in taken))
            taken.append((r[2], r[3]))
        newest = max([r[3] for r in own if r[3] is not None] + ([newest] if newest else []))
    assert got == want and gone[1].clock is not None


def test_idle_state_goes_away(spark, tmp_path):
    """A user who was last seen long before the watermark has no state left, nor has a key that is forgotten."""
    rows = [("a", i, 100 + i % 5, T0 + datetime.timedelta(seconds=i)) for i in range(50)] + [("b", 60, 7, T0 + datetime.timedelta(days=2)), ("b", 61, 7, T0 + datetime.timedelta(days=2, seconds=1))]
    path = str(tmp_path / "h")
    jobs._run(spark, jobs.stream_user_history(replayed(spark, rows, str(tmp_path), 50)).writeStream.format("parquet").option("path", path), path + "-state")
    left = spark.read.format("statestore").option("stateVarName", "stamps").load(path + "-state")
    assert {r[0] for r in left.select("key.key").collect()} == {"7"}
    path = str(tmp_path / "c")
    jobs._run(spark, jobs.stream_alert_suppression(replayed(spark, rows, str(tmp_path), 50), forget_s=3600).writeStream.format("parquet").option("path", path), path + "-state")
    left = spark.read.format("statestore").option("stateVarName", "users").load(path + "-state")
    assert {r[0] for r in left.select("key.key").collect()} == {"b"}


class Store:
    """A state variable that counts the calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        self.calls += 1
        return self.held.get("value", ())

    def update(self, value):
        self.held, self.calls = {"value": value}, self.calls + 1

    put = update

    def containsKey(self, key):
        self.calls += 1
        return key in self.held

    def updateValue(self, key, value):
        self.held[key], self.calls = value, self.calls + 1

    def clear(self):
        self.held, self.calls = {}, self.calls + 1


class Handle:
    def __init__(self):
        self.stores = []

    def getListState(self, *_):
        self.stores.append(Store())
        return self.stores[-1]

    getValueState = getMapState = getListState

    def listTimers(self):
        return iter(())

    def registerTimer(self, _):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


@pytest.mark.parametrize("kind", ["history", "cooldown"])
def test_the_store_is_not_called_for_each_row(kind):
    handle, us = Handle(), [i * 7_000_000 for i in range(3000)]
    processor = History() if kind == "history" else Cooldown(None)
    processor.init(handle)
    for part in (us[:1500], us[1500:]):
        rows = [Row(us=t, message=str(t), user=str(t // 7_000_000 % 5)) for t in part]
        given = iter(rows) if kind == "history" else iter([pd.DataFrame([r.asDict() for r in rows])])
        got = list(processor.handleInputRows(("k",), given, handle))
        assert sum(len(x) for x in got) == 1500 if kind == "cooldown" else len(got) == 1500
    assert sum(s.calls for s in handle.stores) < 50


def test_replay_has_no_small_micro_batches(spark, tmp_path):
    table = spark.range(20_000).withColumn("x", F.xxhash64("id")).repartition(4, "x")
    jobs.replay(table, "id", str(tmp_path), 1000)
    sizes = [spark.read.parquet(str(f)).count() for f in tmp_path.glob("replay-*/part-*.parquet")]
    assert sum(sizes) == 20_000 and max(sizes) <= 1000 and len(sizes) < 25 and min(sizes) > 500
