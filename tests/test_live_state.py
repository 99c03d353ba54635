"""Streams with state and timers against the same over whole batches, in several cuts."""

import os
import random
import uuid
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.streaming import events as ev
from tessella.streaming import sessions

FRAMES = "session long, at_ms long, frame_id long, kind string, body string"


def cut(spark, path, rows, schema, parts):
    """Rows as files of a stream, one for each part, in the order in which the stream takes them."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{path}/tmp{k}")
        name = next(n for n in os.listdir(f"{path}/tmp{k}") if n.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/tmp{k}/{name}", f"{path}/in/{k}.parquet")
        os.utime(f"{path}/in/{k}.parquet", (1_700_000_000 + 10 * k, 1_700_000_000 + 10 * k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(spark, df, path):
    with sessions.keyed_state(spark):
        df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def frames():
    rng, rows = random.Random(4), []
    for s in range(12):
        at = rng.randrange(0, 400)
        for k in range(rng.randint(3, 25)):
            kind = rng.choices(["open", "ack", "chunk", "text", "final", "finish", "close"], [2, 2, 8, 3, 1, 1, 1])[0]
            rows.append((s, at, len(rows), "open" if k == 0 and s % 4 else kind, f"b{k}"))
            at += rng.choice([0, 5, 60, 120])
    return rows


@pytest.mark.parametrize("cuts, late", [([0.5], "0 seconds"), ([0.2, 0.4, 0.6], "0 seconds"), ("mixed", "10 seconds")])
def test_sessions_in_any_cut(spark, tmp_path, cuts, late):
    rows = sorted(frames(), key=lambda f: (f[1], f[2]))
    if cuts == "mixed":  # out of order, as far as the stream waits for
        at = list(range(len(rows)))
        random.Random(1).shuffle(at)
        parts = [at[:40], at[40:90], at[90:]]
    else:
        ends = [0, *(int(c * len(rows)) for c in cuts), len(rows)]
        while any(rows[e][1] == rows[e - 1][1] for e in ends[1:-1]):  # frames of one millisecond come together
            ends = [e + 1 if 0 < e < len(rows) and rows[e][1] == rows[e - 1][1] else e for e in ends]
        parts = [range(a, b) for a, b in zip(ends, ends[1:])]
    want = Counter(map(tuple, sessions.relay(spark.createDataFrame(rows, FRAMES)).collect()))
    parts, rows = [*parts, [len(rows)]], [*rows, (99, 100_000, 10**6, "text", "end")]  # time goes on
    got = Counter(map(tuple, run(spark, sessions.relay_stream(cut(spark, str(tmp_path), rows, FRAMES, parts), late), str(tmp_path)).collect()))
    assert {k: n for k, n in got.items() if k[0] != 99} == want and len(want) > 60


def test_sessions_of_a_batch_in_small_parts(spark):
    """Sessions, one of them without a name, go on over parts of three rows; none is a group of its own in Python."""
    rows = [(None if s == 5 else s, *f) for s, *f in frames()]
    want = Counter()
    for own in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == own), key=lambda f: f[:2])
        want.update((own, *x) for x in sessions.play(sessions.NEW, [], mine, float("inf"), 90, 80)[2])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = sessions.relay(spark.createDataFrame(rows, FRAMES))
        assert Counter(map(tuple, found.collect())) == want and len(want) > 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_sessions_by_the_clock(spark, tmp_path):
    """Frames are played as they come; what waits is sent by a timer."""
    rows = [(1, 0, 0, "open", None), (1, 0, 1, "chunk", "a"), (1, 0, 2, "chunk", "b"), (2, 0, 3, "chunk", "never"), (1, 0, 4, "text", "t")]
    stream = cut(spark, str(tmp_path), rows, FRAMES, [range(5)])
    name = f"t_{uuid.uuid4().hex}"
    with sessions.keyed_state(spark):
        q = sessions.relay_stream(stream, clock=True).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/log").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(120):
            q.awaitTermination(0.5)
            got = [(r.seq, r.kind, r.body) for r in spark.table(name).filter("session = 1").orderBy("seq").collect()]
            if len(got) == 3:
                break
    finally:
        q.stop()
    assert got == [(0, "text", "t"), (1, "chunk", "a"), (2, "chunk", "b")] and spark.table(name).filter("session = 2").count() == 0


def test_limiter_in_several_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted(((rng.randrange(0, 300), rng.randrange(0, 4), k) for k in range(400)))
    rows = [(k, int(u), (1000 + t) * 1_000_000 + rng.choice([0, 0, 500, 999])) for k, (t, u, _) in enumerate(rows)]
    rows.sort(key=lambda r: r[2])
    kept = spark.createDataFrame(rows, "event_id long, user_id long, us long").withColumn("ts", F.timestamp_micros("us"))
    want = Counter((r.user_id, r.event_id, r.recent, r.allowed) for r in ev.sliding_limit(kept, 3, 20).collect())
    ends = [0]
    for e in (90, 200, 310):
        while rows[e][2] // 1000 == rows[e - 1][2] // 1000:
            e += 1
        ends.append(e)
    ends.append(len(rows))
    parts = [range(a, b) for a, b in zip(ends, ends[1:])]
    stream = cut(spark, str(tmp_path), rows, "event_id long, user_id long, us long", parts).withColumn("ts", F.timestamp_micros("us"))
    got = Counter(map(tuple, run(spark, sessions.limited_stream(stream, 3, 20), str(tmp_path)).collect()))
    assert got == want and any(not r[3] for r in want)


class Handle:
    """Counts the elements that a processor puts into list states."""

    def __init__(self):
        self.elements, self.timers = 0, []

    def getListState(self, name, schema, **ttl):
        return ListState(self)

    getValueState = getListState

    def registerTimer(self, at):
        self.timers.append(at)


class ListState:
    def __init__(self, handle):
        self.handle, self.rows = handle, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def appendList(self, rows):
        self.handle.elements += len(rows)
        self.rows = [*self.rows, *rows]

    def put(self, rows):
        self.clear()
        self.appendList(rows)


class Time:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def played(processor, rows, key=(0,)):
    """What a processor sends of rows once time has come to their end, and how many elements of state that took."""
    handle = Handle()
    processor.init(handle)
    list(processor.handleInputRows(key, iter([rows]), Time(0)))
    sent = list(processor.handleExpiredTimer(key, Time(10**9), None))
    return pd.concat(sent), handle.elements


def test_sessions_share_state_and_messages():
    """64 sessions of 50 frames are held as one element of state and sent at once, as each by itself is played."""
    rows = [(s, 1000 + 7 * k, 100 * s + k, "open" if k == 0 else ["chunk", "text"][k % 2], f"b{k}") for s in range(64) for k in range(50)]
    got, elements = played(sessions.RelaySession(90, 80, 1000, False), pd.DataFrame(rows, columns=sessions.FRAMES))
    want = [(s, *x) for s in range(64) for x in sessions.play(sessions.NEW, [], [r[1:] for r in rows if r[0] == s], 10**9, 90, 80)[2]]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want) and len(want) == 64 * 50 - 64
    assert elements <= 1 + 64
    none, _ = played(sessions.RelaySession(90, 80, 1000, False), pd.DataFrame([(None, *r[1:]) for r in rows[:50]], columns=sessions.FRAMES), (None,))
    assert none.session.isna().all() and len(none) == 49


def test_streams_group_neighbours(spark):
    keys = spark.range(-3, 130).select(sessions.block("id")).groupBy("block").count().collect()
    assert {r.block: r["count"] for r in keys} == {-1: 3, 0: 64, 1: 64, 2: 2}
    rows = spark.createDataFrame([(1, 5, 0, "open", None)], FRAMES)
    assert "shiftright" in sessions.relay_stream(rows)._jdf.queryExecution().analyzed().toString()


def test_users_share_state_and_messages(spark):
    """Events of 64 users are held as one element of state, and counted as a batch over all of them counts."""
    rng = random.Random(3)
    rows = [(rng.randrange(64), rng.randrange(1, 90) * 1_000_000, k) for k in range(3000)]
    got, elements = played(sessions.Limiter(3, 20_000_000), pd.DataFrame(rows, columns=["user_id", "at", "event_id"]))
    kept = spark.createDataFrame(rows, "user_id long, us long, event_id long").withColumn("ts", F.timestamp_micros("us"))
    want = Counter((r.user_id, r.event_id, r.recent, r.allowed) for r in ev.sliding_limit(kept, 3, 20).collect())
    assert Counter(got.itertuples(index=False, name=None)) == want and elements == 1
    none, _ = played(sessions.Limiter(3, 20_000_000), pd.DataFrame([(None, *r[1:]) for r in rows[:9]], columns=["user_id", "at", "event_id"]), (None,))
    assert none.user_id.isna().all() and len(none) == 9
    frame = spark.createDataFrame([(1, 2)], "user_id long, event_id long").withColumn("ts", F.current_timestamp())
    assert "shiftright" in sessions.limited_stream(frame, 3, 20)._jdf.queryExecution().analyzed().toString()
