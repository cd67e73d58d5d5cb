"""Components from a delta, pins by tenant, and resampled metrics against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from engramark.operators import graph, metrics, replay


def pairs(df):
    return {(r["node"], r["component"]) for r in df.collect()}


def test_extended_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    batches = [edges[:15], [*edges[15:], (7, 7), (99, 99), (None, 3)], [(100, 101), (101, 0)]]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long")
    now, seen = graph.connected(frame(batches[0])), list(batches[0])
    for batch in batches[1:]:
        now = graph.reliable(graph.extended(now, frame(batch)))
        seen += batch
        assert pairs(now) == pairs(graph.connected(frame([e for e in seen if None not in e])))
    assert len({c for _, c in pairs(now)}) > 1


def test_pins_by_tenant(spark):
    rows = [(1, "pin", "a", "t1"), (2, "pin", "b", None), (3, "query", "a", "t1"), (4, "pin", "a", "t2"), (5, "pin", "a", "t1")]
    events = spark.createDataFrame(rows, "i long, op string, node_id string, tenant_id string")
    left, pins = replay.routed_pins(events, "comprehensive")
    assert [x["i"] for x in left.orderBy("i").collect()] == [2, 3] and {tuple(x) for x in pins.collect()} == {("t1", "a"), ("t2", "a")}
    left, pins = replay.routed_pins(events, "fact_only")
    assert left.count() == 5 and pins.count() == 0


def test_metric_bootstrap(spark):
    r = random.Random(2)
    values = [r.random() for _ in range(23)]
    draw = lambda rep, slot: int(int(hashlib.sha256(f"9:{rep}:{slot}".encode()).hexdigest()[:8], 16) / 4294967296 * len(values))
    most = sorted(max(values[draw(rep, slot)] for slot in range(len(values))) for rep in range(60))
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    got = metrics.metric_bootstrap(df, F.max("v"), 60, 9, 0.1).first()
    assert (got["lo"], got["hi"]) == pytest.approx((most[3], most[int(0.95 * 60) - 1]))
