"""Shown values, reasons, pairs alone, adjusted values, examples and bootstraps against plain Python."""

import random
import statistics

from pyspark.sql import functions as F
from test_consensus import WRITES, brute, embed, dot, may_merge, writes

from engramark.operators import consensus, gates, metrics


def test_shown_values(spark):
    r = random.Random(1)
    values = [2.675, 0.0005, 0.0015, 2.5, 1.005, -2.675, -0.5, 0.5, 1.5, 1e-9, 0.0, 123456.7895, 1e18, 0.285, 1.115, *(r.randrange(10**6) / 2000 for _ in range(400)), *(r.gauss(0, 100) for _ in range(200))]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(-1, None)], "k int, v double")
    for places in (0, 2, 3, 4):
        got = {x["k"]: x["s"] for x in df.select("k", gates.shown(F.col("v"), places).alias("s")).collect()}
        assert got == {k: float(round(v, places)) for k, v in enumerate(values)} | {-1: None}


def test_reason_counts(spark):
    rows = writes(21)
    got = {x["reason"]: x["n"] for x in consensus.reason_counts(spark.createDataFrame(rows, WRITES)).collect()}
    keys, aliases = [], {}
    for _, s, a, label, _ in rows:
        aliases.setdefault((s, label), set()).add(a)
    keys = [k for k, x in aliases.items() if len(x) >= 2]
    few = sum(len(aliases[a] & aliases[b]) < 2 for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] != b[0])
    assert got.get("blocked_overlap_below_min", 0) == few > 0
    assert sum(got.values()) == sum(a[0] != b[0] for i, a in enumerate(keys) for b in keys[i + 1 :])
    assert brute


def test_pairs_alone(spark):
    r = random.Random(3)
    words = ["red", "blue", "ring", "of", "7", "by"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 4))), " ".join(r.choice(words) for _ in range(r.randrange(0, 4)))) for k in range(200)]
    df = metrics.merged_alone(spark.createDataFrame(rows, "k int, a string, b string"), 0.7)
    got = {x["k"]: x["merged"] for x in df.collect()}
    want = {k: a == b or (bool(embed(a) and embed(b)) and dot(embed(a), embed(b)) >= 0.7 - 1e-9 and may_merge(a, b)) for k, a, b in rows}
    assert got == want
    x = metrics.with_examples(df, "k", "merged", ("a", "b"), 3).first()
    assert x["n"] == 200 and x["merged"] == sum(want.values()) and x["examples"] == "; ".join([f"{a} = {b}" for k, a, b in rows if want[k]][:3])


def test_adjusted_values(spark):
    r = random.Random(4)
    rows = [(k, b + r.gauss(0, 1), b) for k in range(100) for b in [r.gauss(5, 2)]]
    got = [x["adjusted"] for x in metrics.adjusted(spark.createDataFrame(rows, "k int, y double, b double"), "y", "b").orderBy("k").collect()]
    theta = statistics.covariance([y for _, y, _ in rows], [b for *_, b in rows]) / statistics.variance([b for *_, b in rows])
    mean = statistics.mean(b for *_, b in rows)
    assert all(abs(g - (y - theta * (b - mean))) < 1e-9 for g, (_, y, b) in zip(got, rows, strict=True))
    assert abs(statistics.variance(got) - metrics.cuped(spark.createDataFrame(rows, "k int, y double, b double"), "y", "b").first()["adjusted_variance"]) < 1e-9


def test_throughput(spark):
    r = random.Random(6)
    rows = [(g, k, r.randrange(1, 30) / 4) for g, n in (("a", 2000), ("b", 130), ("c", 7)) for k in r.sample(range(9000), n)]
    got = {x["g"]: x for x in metrics.throughput(spark.createDataFrame(rows, "g string, k int, ms double"), "k", "ms", "g").collect()}
    for g, warm in (("a", 50), ("b", 6), ("c", 0)):
        ms = [m for _, _, m in sorted(x for x in rows if x[0] == g)][warm:]
        assert (got[g]["warmed"], got[g]["measured"]) == (warm, len(ms)) and abs(got[g]["per_second"] - len(ms) / (sum(ms) / 1000)) < 1e-6
        assert (got[g]["p50"], got[g]["p99"]) == (sorted(ms)[len(ms) // 2], sorted(ms)[min(len(ms) - 1, int(len(ms) * 0.99))])


def test_pairs_are_dealt_to_all_cores(spark):
    df = spark.createDataFrame([(k, f"name {k}", f"name {k} of") for k in range(8)], "k int, a string, b string").coalesce(1)
    assert metrics.merged_alone(df, 0.7).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
