"""Parallel clustering against going through the inputs one by one; sparse pairs against all cosines."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_consensus import dot, forms, joined, may_merge

from engramark.operators import clusters, sparse

SCHEMA = "seq long, source_id string, input string, vector array<double>"


def one_by_one(rows, threshold, guarded, weights):
    seen, want, first = {}, {}, {}
    for _, s, x, v in rows:
        first.setdefault((s, x), v)
    for _, s, x, _ in rows:
        if (s, x) not in want:
            mine = joined(x, first[s, x], weights)
            cosines = [round(dot(mine, e), 12) for _, e in seen.setdefault(s, [])]
            best = cosines.index(max(cosines)) if cosines else None
            if best is not None and cosines[best] >= threshold - 1e-12 and (not guarded or may_merge(x, seen[s][best][0])):
                want[s, x] = seen[s][best][0]
            else:
                seen[s].append((x, mine))
                want[s, x] = x
    return want


@pytest.mark.parametrize(
    ("rows", "threshold", "guarded", "weights", "last"),
    [(forms(5), 0.7, True, (1.0, 0.0), 0), (forms(8, 260, 1), 0.6, True, (1.0, 0.0), 60), (forms(9, 120, 2), 0.75, False, (0.0, 1.0), 30), (forms(10, 200, 2), 0.8, True, (2.0, 1.0), 20_000), (forms(11, 120, 1), 0.5, False, (1.0, 1.0), 20_000)],
)
def test_same_as_one_by_one(spark, rows, threshold, guarded, weights, last, monkeypatch):
    monkeypatch.setattr(clusters, "LAST_INPUTS", last)
    got = clusters.leader_labels(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold, guarded, weights)
    assert got.count() == len(rows)
    labels = {(r["source_id"], r["input"]): r["label"] for r in got.collect()}
    want = one_by_one(rows, threshold, guarded, weights)
    assert labels == want and len(set(want.values())) < len(want)


def test_one_class_of_many(spark, monkeypatch):
    """Spellings of one name, chains of names near the next, names without tokens, and repeated rows."""
    monkeypatch.setattr(clusters, "LAST_INPUTS", 0)
    r = random.Random(3)
    spell = lambda w: " ".join(r.choice((x, x.upper(), x.title())) for x in w)
    names = [spell(["red", "ring", "7"]) + " " * k for k in range(60)] + [" ".join(f"w{j}" for j in range(k, k + 4)) for k in range(25)] + ["--", "__", " ", "red ring", "ring 7 red of"]
    names = [r.choice(names) for _ in range(300)]
    rows = [(k * 3, "s", n, []) for k, n in enumerate(names)]
    got = {r["input"]: r["label"] for r in clusters.leader_labels(spark.createDataFrame(rows, SCHEMA), 0.7).collect()}
    want = {x: label for (_, x), label in one_by_one(rows, 0.7, True, (1.0, 0.0)).items()}
    assert got == want
    assert clusters.leader_labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_index_finds_most(spark):
    rows = forms(12, 240, 1)
    exact, graph = ({r["input"]: r["label"] for r in clusters.leader_labels(spark.createDataFrame(rows, SCHEMA), 0.8, False, (0.0, 1.0), index).collect()} for index in ("exact", "graph"))
    assert sum(exact[k] == graph[k] for k in exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_sparse_pairs(spark, threshold):
    r = random.Random(7)
    bags = {}
    for k in range(260):
        dims = {min(39, int(r.expovariate(0.12))) for _ in range(r.randrange(1, 6))}
        bags[f"k{k:03d}"] = (k % 2, {d: r.choice((-1, 1, 2)) for d in dims})
    unit = {k: (g, {i: c / math.sqrt(sum(x * x for x in b.values())) for i, c in b.items()}) for k, (g, b) in bags.items()}
    want = {(a, b) for a, (g, x) in unit.items() for b, (h, y) in unit.items() if a < b and g == h and dot(x, y) >= threshold - 1e-9}
    df = spark.createDataFrame([(g, k, i, c) for k, (g, b) in unit.items() for i, c in b.items()], "g int, k string, i int, c double")
    found = sparse.pairs(df, threshold, ("g",)).collect()
    assert len(found) == len(want) and {(r["u"], r["v"]) for r in found} == want


def test_frequent_dimension_makes_no_pairs(spark):
    """2,000 names of a word of their own and a common one: none is near another, and none meets another."""
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), F.explode(F.array(F.col("id") + 1, F.lit(0))).alias("i"), F.lit(math.sqrt(0.5)).alias("c"))
    assert sparse.candidates(df, 0.7).count() == 0


def test_longer_names_go_in_once(spark):
    # Every part used to carry its name's vector through the clustering, so that the work grew with the parts.
    from engramark.plans import extended, search

    d = "/root/testdata/sf0.01"
    forms, x = extended.longer_forms(spark, d), search._longer(spark, d)
    first = {r["input"]: (r["seq"], r["oracle"]) for r in forms.orderBy("seq").collect()[::-1]}
    assert {r["input"]: (r["seq"], r["oracle"]) for r in x.collect()} == first and x.count() == len(first) < forms.count()
    labels = search.hybrid_labels(spark, d)
    assert labels.columns == ["seq", "input", "label"] and labels.count() == forms.count()
