"""Dense vectors: the nearest rows and near pairs against all cosines; the graph's recall."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramark.operators import dense, neighbours
from engramark.plans import search

SCHEMA = "id long, vector array<float>, x string, cosine double"


def vectors(n=600, dims=12, clusters=8, seed=1):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(clusters)]
    rows = [(k * 7 % 4999, [float(np.float32(c + r.gauss(0, 0.4))) for c in centres[k % clusters]], "", 0.0) for k in range(n)]
    return rows + [(6000 + k, rows[3][1], "", 0.0) for k in range(4)]


BAD = [(7000, None, "", 0.0), (7001, [], "", 0.0), (7002, [0.0] * 12, "", 0.0), (7003, [math.nan] * 12, "", 0.0), (7004, [None] * 12, "", 0.0), (None, [1.0] * 12, "", 0.0)]


def unit(rows):
    x = np.array([v for _, v, *_ in rows])
    return np.array([i for i, *_ in rows]), x / np.linalg.norm(x, axis=1, keepdims=True)


def truth(rows, queries, top):
    ids, x = unit(rows)
    out = {}
    for k, i in enumerate(ids):
        if i in queries:
            cosines = np.round(x @ x[k], 6)
            order = sorted((-c, j) for c, j in zip(cosines.tolist(), ids.tolist(), strict=True) if j != i)
            out[int(i)] = [(j, -c) for c, j in order[:top]]
    return out


@pytest.fixture(scope="module")
def packed(spark):
    return dense.packed(spark.createDataFrame(vectors() + BAD, SCHEMA).repartition(3)).cache()


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (-round(r["cosine"], 6), r["id"])):
        out.setdefault(r["query"], []).append((r["id"], round(r["cosine"], 6)))
    return out


@pytest.mark.parametrize("top", [1, 5])
def test_nearest_in_blocks(spark, packed, top, monkeypatch):
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 40)
    rows = vectors()
    queries = {i for i, *_ in rows if i % 10 == 0} | {6001}
    asked = packed.where((F.col("id") % 10 == 0) | (F.col("id") == 6001))
    assert by_query(dense.nearest(asked, packed, top)) == truth(rows, queries, top)
    assert dense.nearest(packed.limit(0), packed).count() == 0 and dense.nearest(asked, packed.limit(0)).count() == 0


def test_graph(spark, packed):
    rows = vectors()
    index = neighbours.graph(packed, degree=8)
    links = {r["id"]: r["links"] for r in index.collect()}
    assert len(links) == len(rows) and all(i not in ls and len(set(ls)) == len(ls) <= 2 * 8 + neighbours.RANDOM for i, ls in links.items())
    asked = packed.where("id % 3 = 0")
    found = neighbours.searched(asked, index, top=3, beam=24)
    exact = dense.nearest(asked, packed, 3)
    r = neighbours.recall(found, exact).first()
    assert r["queries"] == exact.select("query").distinct().count() and r["recall"] >= 0.97
    assert neighbours.recall(exact, exact).first()["recall"] == 1.0


def test_backends(spark, packed):
    asked = packed.where("id % 50 = 0")
    linear = by_query(neighbours.nearest(asked, packed, backend="auto"))
    assert linear == by_query(dense.nearest(asked, packed))
    with pytest.raises(ValueError, match="backend"):
        neighbours.nearest(asked, packed, backend="none")
    one = packed.where("id = 7")
    assert neighbours.searched(one, neighbours.graph(one)).count() == 0 and neighbours.graph(packed.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "threshold", "block"), [(vectors(), 0.9, 50), (vectors(300, 12, 300), 0.85, 2048), (vectors(200, 3, 4), 0.99, 7), (vectors(150, 5, 2), -0.2, 64)])
def test_pairs(spark, rows, threshold, block, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", block)
    monkeypatch.setattr(dense, "ROWS_PER_PIVOT", 40)
    monkeypatch.setattr(dense, "DEALT", 100)
    ids, x = unit(rows)
    cosines = x @ x.T
    want = {(min(a, b), max(a, b)) for i, a in enumerate(ids.tolist()) for j, b in enumerate(ids.tolist()) if i < j and cosines[i, j] >= threshold - 1e-9}
    between, members, counts = dense.pairs(dense.packed(spark.createDataFrame(rows, SCHEMA)), threshold)
    found = dense.expanded(between, members).collect()
    assert len(found) == len(want) and {(r["u"], r["v"]) for r in found} == want
    assert {r["id"]: r["class"] for r in members.collect()}[6002] == min(3 * 7, 6000)
    n = len({tuple(v) for _, v, *_ in rows})
    assert counts.first()["verified"] <= n * (n - 1) // 2
    got = {r["id"]: (r["near"], round(r["most"], 9)) for r in dense.links(dense.packed(spark.createDataFrame(rows, SCHEMA)), threshold).collect()}
    assert got == {int(a): (int((c >= threshold - 1e-9).sum()) - 1, round(float(np.delete(c, k).max()), 9)) for k, (a, c) in enumerate(zip(ids, cosines, strict=True)) if (c >= threshold - 1e-9).sum() > 1}


def test_pairs_verify_few(spark):
    """Of 1,500 vectors without structure there are 1,124,250 pairs; a few of them may reach 0.85."""
    r = random.Random(2)
    rows = [(k, [r.gauss(0, 1) for _ in range(26)], "", 0.0) for k in range(1500)]
    between, _, counts = dense.pairs(dense.packed(spark.createDataFrame(rows, SCHEMA)), 0.85)
    ids, x = unit(rows)
    assert between.count() == int((np.triu(x @ x.T, 1) >= 0.85).sum()) and counts.first()["verified"] < 120_000


def test_missed_rows_are_found_by_the_check(spark, packed):
    rows = vectors()
    queries = {i for i, *_ in rows if i % 50 == 0}
    asked = packed.where("id % 50 = 0")
    want = truth(rows, queries, 2)
    poor = dense.nearest(asked, packed, 9).where("cosine < 1").groupBy("query").agg(F.max("id").alias("id"), F.lit(-0.5).alias("cosine"))
    found = neighbours.checked(poor, asked, packed, 2)
    assert by_query(found) == want


def test_beam_widens_until_enough_is_found(spark, packed, monkeypatch):
    monkeypatch.setattr(neighbours, "BEAM", 1)
    asked = packed.where("id % 100 = 0")
    index, right = neighbours.graph(packed), dense.nearest(asked, packed, 5)
    narrow = neighbours.recall(neighbours.searched(asked, index, 5, 5), right).first()["recall"]
    found, share = neighbours.enough(asked, index, right, 5, max(0.9, min(1.0, narrow + 0.001)))
    assert share >= 0.9 and share >= narrow and found.count() == 5 * asked.count()


def test_close_pairs_come_in_strips(monkeypatch):
    # All close pairs of two blocks used to be held at once.
    monkeypatch.setattr(dense, "CELLS", 200)
    r = np.random.default_rng(3)
    a, b = (m / np.linalg.norm(m, axis=1)[:, None] for m in (r.normal(size=(31, 8)), r.normal(size=(50, 8))))
    for threshold in (-1.0, 0.3, 0.9):
        strips = list(dense._close(a, b, threshold))
        assert len(strips) == 8 and all(len(i) <= 200 for i, *_ in strips)
        got = {(x, y) for i, j, *_ in strips for x, y in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(a @ b.T >= threshold - 1e-9), strict=True)}


def test_parted_index(spark, packed, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 100)
    rows = vectors()
    ids, x = unit(rows)
    index = neighbours.parted(packed, degree=8)
    found = {r["id"]: (r["part"], r["links"]) for r in index.collect()}
    assert len(found) == len(rows) == index.count() and len({p for p, _ in found.values()}) == 7
    part = np.array([found[i][0] for i in ids.tolist()])
    for i, (p, links) in found.items():
        assert i not in links and len(set(links)) == len(links) <= 2 * 8 + neighbours.RANDOM and {found[k][0] for k in links} == {p}
        # The nearest of the part are all there.
        cosines = {int(k): c for k, c in zip(ids[part == p], x[part == p] @ x[list(ids).index(i)], strict=True) if k != i}
        assert sorted((cosines[k] for k in links), reverse=True)[:8] == pytest.approx(sorted(cosines.values(), reverse=True)[:8], abs=1e-6)
    asked = packed.where("id % 3 = 0")
    exact = dense.nearest(asked, packed, 3)
    narrow = neighbours.searched(asked, index, 3, 8)
    assert neighbours.recall(narrow, exact).first()["recall"] >= 0.9
    # A beam that holds all nodes reaches all of them.
    monkeypatch.setattr(dense, "QUERIES_AT_ONCE", 200)
    assert by_query(neighbours.searched(asked, index, 3, 1000)) == truth(rows, {i for i, *_ in rows if i % 3 == 0}, 3)
    one = packed.where("id = 7")
    assert neighbours.searched(one, neighbours.parted(one)).count() == 0
    assert neighbours.parted(packed.limit(0)).count() == 0 and neighbours.searched(packed.limit(0), index).count() == 0


def test_parted_index_of_equal_vectors_and_names(spark):
    rows = [(f"n{k:03}", [1.0, 0.5] if k % 2 else [float(np.cos(k)), float(np.sin(k))], "", 0.0) for k in range(200)]
    packed = dense.packed(spark.createDataFrame(rows, SCHEMA.replace("id long", "id string")))
    found = neighbours.searched(packed, neighbours.parted(packed), 2, 200)
    assert by_query(found) == by_query(dense.nearest(packed, packed, 2))


def test_recall_takes_few_jobs(spark, tmp_path):
    """Rounds of joins over all rows for every beam made hundreds of jobs, whatever the size."""
    r = random.Random(5)
    spark.createDataFrame([(k, [r.gauss(0, 1) for _ in range(32)]) for k in range(2000)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.sparkContext.setJobGroup("graph_recall", "")
    found = search.graph_recall(spark, str(tmp_path)).collect()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("graph_recall")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [tuple(x) for x in found] == [(20, True)] and 0 < len(jobs) < 80
