"""The data sources against the readers of workload files, and a writer whose run fails."""

import json
import os

import pytest
from pyspark.sql import functions as F

from engramark.sources import fixtures, formats

FILES = {
    "properties": {"properties": [{"label": "instance of", "aliases": ["is a", "type"]}, {"label": "part of", "aliases": []}, {"label": "size", "aliases": None}]},
    "surfaces": {"surfaces": [{"surface": "apple", "candidates": [{"domain": "fruit", "actual_label": "Apple", "aliases": ["pome"]}, {"domain": "tech", "actual_label": "Apple Inc", "aliases": None}]}]},
    "tags": {"by_source": [{"source": "a", "related_tags": ["x", "y"], "synonyms": [["z", "x"]]}, {"source": "b", "related_tags": None, "synonyms": None}]},
}
READERS = {"properties": fixtures.properties, "surfaces": fixtures.ambiguous_surfaces, "tags": fixtures.tags}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_workloads(spark, tmp_path, kind, monkeypatch):
    formats.register(spark)
    path = tmp_path / f"{kind}.json"
    path.write_text(json.dumps(FILES[kind]))
    got = spark.read.format("workload").option("kind", kind).load(f"file://{path}").orderBy("seq").collect()
    assert got == READERS[kind](spark, str(path)).orderBy("seq").collect() and len(got) >= 3
    monkeypatch.setattr(formats, "ENTRIES", 1)
    slices = formats.WorkloadReader({"path": str(path), "kind": kind})
    assert [row for s in slices.partitions() for row in slices.read(s)] == [tuple(r) for r in got]
    path.write_text(json.dumps({formats.KINDS[kind][0]: []}))
    assert spark.read.format("workload").option("kind", kind).load(str(path)).count() == 0


def test_artifacts(spark, tmp_path):
    formats.register(spark)
    path = f"file://{tmp_path}/runs"
    runs = spark.createDataFrame([(f"run-{k}", json.dumps({"k": k})) for k in range(20)], formats.ARTIFACTS).repartition(3)
    runs.write.format("artifacts").mode("append").save(path)

    # The third row's task fails after others have written: nothing of the run is to be seen.
    broken = runs.withColumn("body", F.when(F.col("name") == "run-7", F.raise_error(F.lit("no"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="no"):
        broken.write.format("artifacts").mode("append").save(path)
    found = spark.read.format("artifacts").load(path)
    assert sorted(tuple(r) for r in found.collect()) == sorted((f"run-{k}", json.dumps({"k": k})) for k in range(20))
    assert not [f for f in os.listdir(tmp_path / "runs") if f.startswith(("_staged", "_list-"))]

    more = spark.createDataFrame([("last-one", "{}")], formats.ARTIFACTS)
    more.write.format("artifacts").mode("append").save(path)
    assert spark.read.format("artifacts").load(path).count() == 21
    more.write.format("artifacts").mode("overwrite").save(path)
    assert [tuple(r) for r in spark.read.format("artifacts").load(path).collect()] == [("last-one", "{}")]
    assert spark.read.format("artifacts").load(f"{path}-none").count() == 0
