"""Stated workloads have the counts they should; the ladder compares both runs of each model."""

import pytest
from pyspark.sql import functions as F

from engramark.operators import metrics
from engramark.sources import literals
from engramark.sources.generators import WORKLOADS


def test_stated_workloads(spark):
    x = WORKLOADS.load(spark, "relations")
    assert (x.count(), x.select("oracle").distinct().count()) == (131, 34)
    assert tuple(x.orderBy("seq").first()) == (0, "default", "IsA", "IsA")
    y = WORKLOADS.load(spark, "tenants")
    assert (y.count(), y.select("oracle").distinct().count()) == (33, 12)
    assert {r["oracle"] for r in y.where("input = 'Apple'").collect()} == {"Apple_Inc", "Apple_Supplier_Inc"}


def test_strata(spark):
    entries = [("conditional", "B", {"ops": ["b"]}), ("global", "A", {"sales": ["a", "a1"], "ops": ["a"]}), ("partial", "B", {"eng": ["b", "b1"]})]
    rows = literals.stratified(spark, entries).orderBy("seq").collect()
    assert [tuple(r)[1:] for r in rows] == [("sales", "a", "A", "global"), ("sales", "a1", "A", "global"), ("ops", "a", "A", "global"), ("eng", "b", "B", "partial"), ("eng", "b1", "B", "partial"), ("ops", "b", "B", "partial")]
    assert spark.range(1).select(literals.stratum_of(F.lit("C"), entries).alias("s")).first()["s"] == "unknown"
    assert literals.stratified(spark, []).count() == 0


def test_proxy_ladder(spark):
    rows = [(m, k, on, f"o{k % (2 if on else 5)}", on or k % 2 == 0 if m == "a" else k % 3 == 0, on) for m in "ab" for k in range(40) for on in (False, True)]
    got = {r["model"]: r for r in metrics.proxy_ladder(spark.createDataFrame(rows, "model string, k long, proxy boolean, output string, right boolean, canonical boolean"), 200).collect()}
    a, b = got["a"], got["b"]
    assert (a["n"], a["accuracy_off"], a["accuracy_on"], a["accuracy_diff"], a["canonical_diff"], a["unique_off"], a["unique_on"]) == (40, 0.5, 1.0, 0.5, 1.0, 5, 2)
    assert 0.2 < a["lo"] < 0.5 < a["hi"] < 0.8 and a["p1"] == 0.0
    assert (b["accuracy_diff"], b["lo"], b["hi"], b["p1"]) == pytest.approx((0.0, 0.0, 0.0, 1.0))
