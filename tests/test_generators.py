"""Generated logs and tasks are what they were asked to be; artifacts come back as they were written."""

import json

import pytest
from pyspark.sql import functions as F

from engramark.operators import mentions, replay
from engramark.sinks import artifacts
from engramark.sources import generators as g

DAY = 86400.0


def test_churn_log(spark):
    log = g.churn(spark, 20, 100, n_tenants=3, dormant_fraction=0.2, asked_after_fraction=0.1, seed=5)
    rows = log.orderBy("i").collect()
    assert [x["i"] for x in rows] == list(range(1, len(rows) + 1)) and all(a["ts"] <= b["ts"] for a, b in zip(rows, rows[1:], strict=False))
    count = lambda op, kind=None: sum(x["op"] == op and kind in (None, x["kind"]) for x in rows)
    assert count("add_node", "entity") == 20 and count("add_node", "fact") == 100 and count("pin") == 2 and count("query") == 30 + 10
    edges = [(x["src"], x["dst"]) for x in rows if x["op"] == "add_edge"]
    assert len(set(edges)) == len(edges) == count("remove_edge") and 100 <= len(edges) <= 300
    assert len({x["node_id"] for x in rows if x["op"] == "query" and x["node_id"][0] == "e"}) <= 16
    assert {x["tenant_id"] for x in rows if x["op"] == "pin"} <= {"tenant_000", "tenant_001", "tenant_002"}
    assert log.orderBy("i").collect() == g.churn(spark.newSession(), 20, 100, n_tenants=3, dormant_fraction=0.2, asked_after_fraction=0.1, seed=5).orderBy("i").collect()
    run = replay.replayed(log, "fact_only", 400)
    assert run.counts["collected"] > 0 and run.graph.nodes.where("kind = 'entity'").count() == 20


@pytest.mark.parametrize("archetype", ["supersession-heavy", "adversarial-no-supersession", "cluster-rich", "large-fact"])
def test_archetypes(spark, archetype):
    log = g.WORKLOADS.load(spark, archetype)
    stats = g.log_stats(log).first()
    assert stats["n_entities"] == 50 and stats["n_facts"] == 500 and stats["n_pinned"] == 2
    assert (stats["supersession_rate"] > 0.2) == (archetype == "supersession-heavy") and (stats["n_supersessions"] == 0) == (archetype == "adversarial-no-supersession")
    most = log.where("op = 'add_edge'").groupBy("dst").count().agg(F.max("count")).first()[0]
    assert (most > 100) == (archetype == "cluster-rich")
    assert (log.where("op = 'add_edge'").groupBy("src").count().where("count > 10").count() > 20) == (archetype == "large-fact")


def test_unknown_workload(spark):
    with pytest.raises(KeyError):
        g.WORKLOADS.load(spark, "none")


def test_samplers(spark):
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    x = u.select(g.zipf(F.col("u"), 4).alias("z"), g.weibull(F.col("u"), 0.7, 2.0).alias("w"), g.weighted(F.col("u"), g.FAILURES).alias("k"))
    share = {r["z"]: r["count"] / 20_000 for r in x.groupBy("z").count().collect()}
    assert all(share[k] == pytest.approx(12 / 25 / (k + 1), abs=0.001) for k in range(4))
    assert x.agg(F.median("w")).first()[0] == pytest.approx(2.0 * 0.6931 ** (1 / 0.7), rel=0.01)
    assert {r["k"]: r["count"] / 20_000 for r in x.groupBy("k").count().collect()} == pytest.approx(g.FAILURES, abs=0.001)


def test_tasks(spark):
    x = g.cross_scenarios(spark, 400).collect()
    assert len(x) == 400 and all(r["fail_step"] is None or 0 < r["fail_step"] < r["n_steps"] - 1 for r in x)
    assert 0.2 < sum(r["kind"] is not None for r in x) / 400 < 0.4 and all("{" not in r["goal"] and 2 <= len(r["required"]) <= 3 for r in x)
    assert len({r["task_class"] for r in g.policy_tasks(spark, 200).collect()}) == 4
    memories, queries = g.question_corpus(spark)
    assert memories.count() == 200 and 60 <= memories.where("aged").count() <= 100 and queries.first()["query"].startswith("Tell me about")
    items = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c"), (3, "b")], "seq long, context string")
    assert {r["seq"]: r["memory"] for r in g.first_contexts(items).collect()} == {0: 0, 1: 1, 2: 0, 3: 2}


def test_extracted_mentions_as_events(spark):
    texts = [(0, 1.0, "Acme met the Bolt team"), (1, 2.0, "ACME again"), (2, 3.0, "acmeX is other"), (3, 4.0, "bolt, acme"), (4, 5.0, "acme once more")]
    df = g.extracted(spark.createDataFrame(texts, "seq long, ts double, text string"), {"acme": "Acme", "bolt": "Bolt"}, 2)
    assert {x["seq"]: x["entities"] for x in df.collect()} == {0: ["Acme", "Bolt"], 1: ["Acme"], 3: ["Bolt", "Acme"]}
    log = g.mention_events(df, 1, DAY).orderBy("i").collect()
    assert [x["node_id"] for x in log if x["op"] == "pin"] == ["Acme"] and sum(x["op"] == "remove_edge" for x in log) == 5


def test_artifacts(spark, tmp_path):
    d = f"file://{tmp_path}/runs"
    artifacts.run_artifact(spark, d, "v", "b", "w", "sha256:0", "fast", [{"outcome": "SUPERIOR"}], artifacts.ledger_block(0.1, 0.4412, 0.05, 0.04, [3]), "PASS_AND_MERGE")
    with pytest.raises(ValueError):
        artifacts.run_artifact(spark, d, "v", "b", "w", "s", "slow", [], {}, "PASS")
    body = json.loads(artifacts.artifacts(spark, d).first()["body"])
    assert set(body) == {"artifact_metadata", "sequential_fdr_ledger", "test_executions", "pipeline_decision"} and body["sequential_fdr_ledger"]["prior_rejections"] == [3]
    for name, rates in (("20250101", [1.0]), ("20250102", [50.0, 70.0, 20.0, 60.0])):
        front = [{"prompt": "p", "tools": "t", "recovery": "r", "completion_rate_pct": r} for r in rates]
        path = artifacts.dimension_artifact(spark, f"{d}2/{name}.json", "o", "prompt", 3, "e", [], {}, {}, {}, "PASS", {}, {"x": 1})
        artifacts._written(spark, {"pareto_frontier": front, "baseline_completion_pct": 55.0}, f"{d}3/{name}.json")
    assert path.endswith("20250102.json") and json.loads(artifacts.latest(artifacts.artifacts(spark, f"{d}2")).first()["body"])["raw"] == {"x": 1}
    got = artifacts.best_bundles(artifacts.artifacts(spark, f"{d}3")).collect()
    assert [x["completion_rate_pct"] for x in got] == [70.0, 60.0, 50.0] and got[0]["label"].startswith("high") and got[2]["label"].startswith("cost")


def test_profiles(spark, tmp_path):
    (tmp_path / "quick.yaml").write_text("# a profile\nmin_query_count: 2   # fewer\ntombstone_ttl_seconds: 3600\ntenant_pinning_enabled: no\nunknown_key: 3\n  nested: 1\nempty:\nactivation_window_seconds: 1.5e3\n")
    got = artifacts.profiles(spark, f"file://{tmp_path}")
    assert list(got) == ["quick"] and got["quick"] == artifacts.Profile(min_query_count=2, tombstone_ttl_seconds=3600, tenant_pinning_enabled=False, activation_window_seconds=1500.0)


def test_mentions(spark):
    assert [s["surface"] for s in mentions.spans("Licensee has a License, see IBM", ("License", ""))] == ["Licensee", "License", "IBM"]
    one = lambda c, text: spark.createDataFrame([(text,)], "text string").select(c.alias("x")).first()["x"]
    assert one(mentions.replaced_once(F.col("text"), {"ab": "b", "b": "X"}), "ab ab b") == "X ab b"
    assert one(mentions.apart(F.col("text"), ("ann", "bob")), "ann bob,ann") == ["ann", "ann"]
    last = mentions.alias_map(spark.createDataFrame([(0, "a", "x"), (1, "a", "y"), (2, "b", "z")], "seq long, alias string, canonical string"))
    assert {x["alias"]: x["canonical"] for x in last.collect()} == {"a": "y", "b": "z"}
    said = spark.createDataFrame([("Acme Corp grew. It won. The firm paid Bob.", [[(0, 9), (16, 18), (24, 32)], [(38, 41)]])], "text string, c array<array<struct<start: int, end: int>>>")
    assert said.select(mentions.resolved("text", "c").alias("x")).first()["x"] == "Acme Corp grew. Acme Corp won. Acme Corp paid Bob."
    df = spark.createDataFrame([([("user", "hi"), ("bot", None)], "hi", 3)], "m array<struct<role: string, content: string>>, s string, n int")
    got = mentions.message_contents(mentions.message_contents(mentions.message_contents(df, "m", F.upper), "s", F.upper), "n", F.upper).first()
    assert [tuple(x) for x in got["m"]] == [("user", "HI"), ("bot", None)] and got["s"] == "HI" and got["n"] == 3
