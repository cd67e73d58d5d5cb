"""Gates and workload files."""

import json

from pyspark.sql import functions as F

from engramark.operators import gates
from engramark.sources import fixtures


def test_outcome_gates(spark):
    outcomes = spark.createDataFrame([("SUPERIOR",), ("INCONCLUSIVE",), (None,)], "outcome string")
    assert gates.inconclusive_fails(outcomes, "fast").first()["passed"] is False
    assert gates.inconclusive_fails(outcomes, "nightly").first()["passed"] is True
    assert gates.inconclusive_fails(outcomes.limit(0), "fast").first()["passed"] is True


def test_null_share(spark):
    history = spark.createDataFrame([(0.6,), (0.9,)], "null_share double")
    assert gates.null_share_ok(history).first()["passed"] is False
    assert gates.null_share_ok(history.where("null_share < 0.7")).first()["passed"] is True
    assert gates.null_share_ok(history.limit(0)).first()["passed"] is True


def test_baseline_age(spark):
    bodies = ['{"artifact_metadata": {"timestamp_utc": "2026-01-10T00:00:00Z"}}', '{"timestamp_utc": "2026-01-01T00:00:00+00:00"}', '{"timestamp_utc": "2025-12-31T23:59:59Z"}', "{}", "no json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "k int, body string")
    now = F.lit("2026-01-15T00:00:00Z").cast("timestamp")
    assert [r["passed"] for r in gates.baseline_fresh(df, now).orderBy("k").collect()] == [True, True, False, False, False, False]


def test_f1_floor(spark):
    df = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 75.0), (3, 5.0, 74.9), (4, 5.0, None)], "k int, reduction_pct double, preservation_pct double")
    assert [r["passed"] for r in gates.f1_floor(df).orderBy("k").collect()] == [True, True, False, False]


def test_cost_ratio(spark):
    df = spark.createDataFrame([(1, 10.0, 5, 20.0, 4), (2, 10.0, 5, 0.0, 0), (3, 10.0, 0, 0.0, 0), (4, 10.0, 0, 20.0, 4)], "k int, c double, d int, bc double, bd int")
    got = [r[0] for r in df.orderBy("k").select(gates.cost_ratio(*map(F.col, ("c", "d", "bc", "bd")))).collect()]
    assert got == [0.4, 0.0, float("inf"), 2.0]


def file(tmp_path, data):
    path = tmp_path / "w.json"
    path.write_text(json.dumps(data, indent=1))
    return f"file://{path}"


def entries(df):
    return [(r["source_id"], r["input"], r["oracle"]) for r in df.orderBy("seq").collect()]


def test_properties(spark, tmp_path):
    path = file(tmp_path, {"properties": [{"label": "born", "aliases": ["birth", "b."]}, {"label": "died", "aliases": []}]})
    assert entries(fixtures.properties(spark, path)) == [("default", "born", "born"), ("default", "birth", "born"), ("default", "b.", "born"), ("default", "died", "died")]


def test_ambiguous_surfaces(spark, tmp_path):
    one = {"domain": "cars", "actual_label": "Ford M", "aliases": ["M1"]}
    two = {"domain": "birds", "actual_label": "m", "aliases": []}
    path = file(tmp_path, {"surfaces": [{"surface": "M", "candidates": [one, two]}, {"surface": "N", "candidates": [two]}]})
    assert entries(fixtures.ambiguous_surfaces(spark, path)) == [("cars", "M", "Ford M"), ("cars", "Ford M", "Ford M"), ("cars", "M1", "Ford M"), ("birds", "M", "m"), ("birds", "N", "m"), ("birds", "m", "m")]
    assert [r[0] for r in fixtures.surfaces_of_several(spark, path).collect()] == ["M"]


def test_tags(spark, tmp_path):
    path = file(tmp_path, {"by_source": [{"source": "go", "related_tags": ["map"], "synonyms": [["golang", "go"]]}, {"source": "c", "related_tags": ["ptr"]}]})
    assert entries(fixtures.tags(spark, path)) == [("go", "map", "map"), ("go", "golang", "go"), ("c", "ptr", "ptr")]


def test_memory_items(spark, tmp_path):
    path = file(tmp_path, [{"question_id": "q1", "question": " who ", "answer": 7}, {"question_id": "q2", "question": " ", "answer": "x"}])
    assert [tuple(r) for r in fixtures.memory_items(spark, path).collect()] == [("haystack", "who", "q1"), ("answer", "7", "q1")]


def test_pairs(spark, tmp_path):
    path = file(tmp_path, {"pairs": [{"a": "x", "b": "y", "cosine": 0.9}]})
    assert [tuple(r) for r in fixtures.adversarial_pairs(spark, path).collect()] == [("x", "y", 0.9)]
