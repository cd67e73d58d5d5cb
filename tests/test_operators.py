"""Truth tables and independent re-computations of operators."""

import random
from collections import Counter

from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators import canonical, lifecycle, mentions, metrics, simulate
from engramark.operators.graph import connected


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, text.tokens("a"), a="APIKeyWorksAt_x-y z") == ["api", "key", "works", "at", "x", "y", "z"]


def test_merge_guard(spark):
    pairs = [("born in", "born", False), ("born", "born in", False), ("win 1", "win 2", False), ("win 1", "win 1", True), ("a b of to", "a b", True), ("works_at", "works", False), ("big", "big red", True)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    assert df.where(text.merge_allowed("a", "b") != F.col("ok")).count() == 0


def test_percentile_conventions(spark):
    for n in (1, 2, 5, 100, 101):
        values = sorted(random.Random(n).random() for _ in range(n))
        df = spark.createDataFrame([(values,)], "v array<double>")
        got = df.select(metrics.percentile_floor(F.col("v"), 0.99).alias("a"), metrics.percentile_round(F.col("v"), 0.5).alias("b")).first()
        assert got["a"] == values[min(n - 1, int(0.99 * n))]
        assert got["b"] == values[max(0, min(n - 1, round(0.5 * n) - 1))]


def test_outcome_order(spark):
    cases = [(0.1, 0.2, 0.01, "SUPERIOR"), (0.1, 0.2, 0.2, "FAIL_TO_REJECT"), (-0.2, -0.1, 0.9, "REGRESSION"), (-0.1, 0.1, 0.5, "INCONCLUSIVE")]
    df = spark.createDataFrame(cases, "lo double, hi double, p double, want string")
    assert df.where(metrics.outcome(F.col("lo"), F.col("hi"), F.col("p")) != F.col("want")).count() == 0


def test_tombstone_window(spark):
    cases = [(10.0, 5.0, True), (5.0, 10.0, False), (5.0 + 7 * 86400, 5.0, True), (6.0 + 7 * 86400, 5.0, False), (1.0, None, False)]
    df = spark.createDataFrame(cases, "q double, c double, want boolean")
    assert df.where(lifecycle.tombstone_hit(F.col("q"), F.col("c")) != F.col("want")).count() == 0


def test_clustering_metrics_against_pairs(spark):
    r = random.Random(3)
    rows = [(k, f"l{r.randrange(6)}", f"o{r.randrange(5)}") for k in range(60)]
    df = spark.createDataFrame(rows, "seq int, label string, oracle string").withColumn("variant", F.lit("v"))
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0]]
    same = sum(a[1] == b[1] and a[2] == b[2] for a, b in pairs)
    got = metrics.pairwise(df, "variant").first()
    assert abs(got["pair_precision"] - same / sum(a[1] == b[1] for a, b in pairs)) < 1e-9
    assert abs(got["pair_recall"] - same / sum(a[2] == b[2] for a, b in pairs)) < 1e-9
    items = {x["seq"]: x["f1"] for x in metrics.per_item(df, "variant").collect()}
    for k, label, oracle in rows:
        cell = sum(x[1:] == (label, oracle) for x in rows)
        p, q = cell / sum(x[1] == label for x in rows), cell / sum(x[2] == oracle for x in rows)
        assert abs(items[k] - 2 * p * q / (p + q)) < 1e-9


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {x["node"]: x["component"] for x in connected(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_leader_clusters_follow_order(spark):
    rows = [(1, "s", "works at", "o"), (2, "s", "worksAt", "o"), (3, "s", "at works", "o"), (4, "s", "works at home now", "o"), (5, "s", "works", "o"), (6, "t", "works-at", "o")]
    got = {x["seq"]: x["label"] for x in canonical.leader_clusters(spark.createDataFrame(rows, "seq long, source_id string, input string, oracle string")).collect()}
    # "works" is near, but "at" is a function word that only the other has.
    assert got == {1: "works at", 2: "works at", 3: "works at", 4: "works at", 5: "works", 6: "works-at"}


def test_fact_sweeps_against_replay(spark):
    r = random.Random(11)
    events, t = [], 0.0
    live = Counter()
    for _ in range(600):
        t += r.choice((600.0, 7200.0, 40000.0))
        fact, entity = r.randrange(25), r.randrange(6)
        op = -1 if live[fact, entity] and r.random() < 0.6 else 1
        live[fact, entity] += op
        events.append((fact, entity, t, op))
    log = lifecycle.numbered(spark.createDataFrame(events, "fact long, entity long, ts double, op int"), "ts", "op")
    for every, age in ((7, 86400.0), (50, 5 * 86400.0)):
        added, count, degree, tick = {}, Counter(), Counter(), {}
        for i, (fact, entity, ts, op) in enumerate(events, 1):
            added.setdefault(fact, ts)
            count[fact, entity] += op
            degree[fact] += 1 if op == 1 else -(count[fact, entity] == 0)
            if i % every == 0 or i == len(events):
                for f in added:
                    if f not in tick and degree[f] == 0 and ts - added[f] >= age:
                        tick[f] = i
        got = {x["fact"]: x["tick"] for x in lifecycle.fact_sweeps(log, every, age).collect()}
        assert got == {f: tick.get(f) for f in added}


def test_ledger_against_loop(spark):
    r = random.Random(2)
    ps = [r.random() ** 8 for _ in range(30)]
    import math

    def gamma(n):
        return 0.4412 / (n * math.log2(n + 1) ** 2)

    hits, wealth, want = [], 0.05, []
    for n, p in enumerate(ps, 1):
        alpha = min(0.1, gamma(n) * 0.05 + sum(gamma(n - h) * (0.05 if j == 0 else 0.1) for j, h in enumerate(hits)))
        wealth += (0.1 if p <= alpha else 0) - alpha
        if p <= alpha:
            hits.append(n)
        want.append((alpha, wealth))
    got = metrics.ledger(spark.createDataFrame([*enumerate(ps, 1)], "n long, p_value double")).orderBy("n").collect()
    assert all(abs(g["alpha"] - a) < 1e-12 and abs(g["wealth"] - w) < 1e-9 for g, (a, w) in zip(got, want, strict=True))


def test_spans_and_splice(spark):
    s = mentions.spans("We met Anna of Berlin and NASA at New York Inc. today")
    assert [x["surface"] for x in s] == ["We", "Anna of Berlin", "NASA", "New York Inc"]
    df = mentions.named(spark.createDataFrame([("Anna met Bob",), (None,)], "text string"), "text")
    assert [x["m"] for x in df.select(mentions.spliced("text", "spans", F.lit("_")).alias("m")).collect()] == ["_ met _", None]


def test_longest_alias_first(spark):
    df = mentions.substituted(spark.createDataFrame([("new york newer",)], "text string"), "text", {"new": "N", "new york": "NY"})
    assert df.first()["normalized"] == "NY Ner"


def test_pareto_against_pairs(spark):
    r = random.Random(9)
    rows = [(k, r.randrange(8), r.randrange(8)) for k in range(40)]
    want = {a[0] for a in rows if not any(b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in rows)}
    assert {x["k"] for x in simulate.pareto(spark.createDataFrame(rows, "k int, gain int, cost int"), "gain", "cost").collect()} == want


def test_label_permutation_changes_nothing(spark):
    rows = [(k, f"l{k % 4}", f"o{k % 3}") for k in range(24)]
    df = spark.createDataFrame(rows, "seq int, label string, oracle string").withColumn("v", F.lit(1))
    other = df.withColumn("label", F.reverse("label"))
    assert metrics.pairwise(df, "v").collect() == metrics.pairwise(other, "v").collect()


def test_single_entity_goes_by_ascii_words(spark):
    texts = ["derü", "thé", "éthe x", "other", "the_x", "İthe", None, "THE of", "x-for."]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found = [r["e"] for r in df.select("k", mentions.single_entity(F.col("text"), {"the": ("the",), "of": ("of", "for"), "und": ("und", "der")}).alias("e")).orderBy("k").collect()]
    assert found == ["und", "the", "the", None, None, None, None, None, "of"]


def test_sweeps_go_through_a_day_once(spark):
    # A frame that ends with the partition is gone through anew for each row.
    log = lifecycle.numbered(spark.createDataFrame([(k, k % 3, 40.0 * k, 1, 1) for k in range(50)] + [(k, k % 3, 4e6 + 40.0 * k, -1, 1) for k in range(50)], "fact long, entity long, ts double, op int, line int"), "ts", "op", "fact")
    x = lifecycle.fact_sweeps(log, 10, 3600.0)
    assert "unboundedfollowing" not in x._jdf.queryExecution().optimizedPlan().toString().lower()
    assert x.where("tick is not null").count() == 50
