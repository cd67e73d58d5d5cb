"""Streams of tombstones against tables, over several batches and a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from engramark.operators import replay as graph_replay
from engramark.streaming import replay, tombstones

TTL = 3600.0 * 24
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "node_id string, at timestamp, op string, superseded_by string"


def events(seed=1, n=300):
    r = random.Random(seed)
    t, rows = START, []
    for k in range(n):
        t += timedelta(seconds=r.randrange(0, 5000))
        rows.append((f"n{r.randrange(25)}", t, r.choice(("collect", "query", "query")), r.choice((None, f"n{k}"))))
    rows += [(None, t, "query", None), ("n1", None, "collect", None)]
    # Several events of a node at one moment would have no order of their own.
    return list({(x[0], x[1]): x for x in rows}.values())


def as_set(df):
    return sorted(tuple(str(x) for x in r) for r in df.select("node_id", "kind", "collected_ms", "at_ms", "superseded_by").collect())


def test_time_to_live(spark, tmp_path):
    rows = events()
    parts = [rows[:110], rows[110:200], rows[200:]]
    folder, given = f"file://{tmp_path}/run", f"{tmp_path}/events"

    def run():
        return tombstones.appended(tombstones.lifetimes(replay.event_stream(spark, given), TTL, "0 seconds"), folder)

    spark.createDataFrame(parts[0], SCHEMA).coalesce(1).write.mode("append").parquet(given)
    run()
    # The next run takes up the state of the one before.
    for part in parts[1:]:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(given)
        out = run()
    end = max(x[1] for x in rows if x[1])
    until = int(end.timestamp() * 1000)
    table = spark.createDataFrame(rows, SCHEMA)
    assert as_set(out) == as_set(tombstones.lifetimes_of_log(table, TTL, until))
    assert {r["kind"] for r in out.collect()} == {"hit", "evicted"}

    # What is in the state is what pruning leaves of the last tombstones.
    last = table.where("op = 'collect' and at is not null").groupBy("node_id").agg((F.max(F.unix_millis("at")) / 1000).alias("collected_at"))
    left, evicted = graph_replay.pruned(last, until / 1000, TTL)
    held = {(r["node_id"], r["collected_ms"]) for r in tombstones.alive(spark, f"{folder}/state").collect()}
    assert held == {(r["node_id"], round(r["collected_at"] * 1000)) for r in left.collect()} and held
    assert last.agg(evicted).first()[0] > 0


def test_rounded_times_and_late_evictions(spark, tmp_path):
    at = lambda seconds, micros=0: START + timedelta(seconds=seconds, microseconds=micros)
    rows = [
        ("a", at(0, 1500), "collect", None), ("a", at(5, 2499), "query", None),
        # A question after the tombstone's life; the watermark, an hour behind, hasn't passed it.
        ("b", at(TTL), "collect", None), ("b", at(2 * TTL + 60), "query", None),
        # The watermark comes to the end of this life, not beyond it.
        ("c", at(TTL - 3540, 600), "collect", None), ("d", at(2 * TTL + 60, 700), "query", None),
    ]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events")
    out = tombstones.appended(tombstones.lifetimes(replay.event_stream(spark, f"{tmp_path}/events"), TTL))
    ms, life = int(START.timestamp() * 1000), round(TTL * 1000)
    want = [("a", "evicted", ms + 2, ms + 2 + life), ("a", "hit", ms + 2, ms + 5002)]
    assert sorted(tuple(r)[:4] for r in out.collect()) == want
    until = ms + 1 + 2 * life + 60_000 - 3_600_000
    assert as_set(out) == as_set(tombstones.lifetimes_of_log(spark.createDataFrame(rows, SCHEMA), TTL, until))


def test_interval_join(spark, tmp_path):
    r = random.Random(4)
    at = lambda hours: START + timedelta(hours=hours)
    tombs = [(f"n{r.randrange(12)}", at(r.randrange(200)), k) for k in range(80)]
    asked = [(f"n{r.randrange(15)}", at(r.randrange(260)), k) for k in range(120)] + [(None, at(3), -1)]
    frames = {"t": spark.createDataFrame(tombs, "node_id string, collected_at timestamp, tomb int"), "q": spark.createDataFrame(asked, "node_id string, asked_at timestamp, ask int")}
    for name, df in frames.items():
        df.orderBy(df.columns[1]).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    streams = {name: replay.event_stream(spark, f"{tmp_path}/{name}") for name in frames}
    found = tombstones.appended(tombstones.interval_hits(streams["q"], streams["t"], TTL))
    want = {(k, j) for n, q, k in asked for m, c, j in tombs if n == m and timedelta(0) <= q - c <= timedelta(seconds=TTL)}
    assert {(x["ask"], x["tomb"]) for x in found.collect()} == want and found.count() == len(want) > 0
    assert {(x["ask"], x["tomb"]) for x in tombstones.interval_hits(frames["q"], frames["t"], TTL).collect()} == want


def test_next_ticks(spark, tmp_path):
    r = random.Random(5)
    rows = [(k, START + timedelta(seconds=r.randrange(40_000))) for k in range(60)] + [(90, START + timedelta(hours=3))]
    ticks = [(START + timedelta(hours=h),) for h in range(9)]
    spark.createDataFrame(rows, "k int, at timestamp").write.parquet(f"{tmp_path}/e")
    spark.createDataFrame(ticks, "tick timestamp").write.parquet(f"{tmp_path}/t")
    x = tombstones.next_ticks(replay.event_stream(spark, f"{tmp_path}/e"), replay.event_stream(spark, f"{tmp_path}/t"), 3600, "20 hours")
    got = {(y["k"], y["tick"].replace(tzinfo=timezone.utc) if y["tick"].tzinfo is None else y["tick"]) for y in tombstones.appended(x).collect()}
    assert {k for k, _ in got} == {k for k, t in rows if t <= ticks[-1][0]}
    assert got == {(k, min(c for (c,) in ticks if c >= t)) for k, t in rows if t <= ticks[-1][0]}


@pytest.fixture(autouse=True)
def utc(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()
