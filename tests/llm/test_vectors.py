"""Whitening and vector codes against versions that hold all vectors in one place."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from engramark.llm import codes, scratch, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, _x string, s double"


def table(dims=12, n=700, seed=3):
    """Vectors near few centres, with every row that is to go, repeated ids and rows, null ids and labels."""
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.3) for _ in range(dims)] for _ in range(5)]
    rows = [(k * 3 % 1009, [c + r.gauss(0, 0.05 * (1 + d % 4)) for d, c in enumerate(centres[k % 5])], (k % 5, None)[k % 7 == 0], "a", 0.5) for k in range(n)]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1], 2, "b", None), (None, rows[4][1], None, None, None), (None, rows[5][1], 3, None, None)]
    bad = [None, [], [None] * dims, [math.nan] * dims, [math.inf] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [-math.inf], [0.1] * (dims + 1)]
    return rows + [(5000 + k, v, 1, "x", 1.0) for k, v in enumerate(bad)]


def kept(rows, dims=12):
    out = []
    for vec_id, v, label, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            out.append((vec_id, label, [math.floor(1024 * float(np.float32(x))) for x in v]))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(5)


@pytest.mark.parametrize("spread", [3, 900, 1 << 24])
def test_nearest(spread):
    r = np.random.default_rng(spread)
    for width in (1, 2, 3, 7, 16):
        book = r.integers(-spread, spread, (256, width))
        book[100:110] = book[:10]
        x = np.concatenate([r.integers(-spread, spread, (3000, width)), book[::-1]])
        every = ((x[:, None, :] - book[None]) ** 2).sum(2)
        index, distance = codes.nearest(x, book)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_codes(spark, frame):
    rows = kept(table())
    cuts = codes.bounds(12)
    ordered = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, np.array(x[2], "<i8").tobytes()))
    books = [[tuple(v[a:b]) for _, _, v in ordered[:256]] for a, b in cuts]
    near = lambda part, book: min((sum((p - q) ** 2 for p, q in zip(part, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(codes.ROUNDS):
        for p, (a, b) in enumerate(cuts):
            members = {}
            for _, _, v in rows:
                members.setdefault(near(v[a:b], books[p])[1], []).append(v[a:b])
            books[p] = [tuple(sum(c) // len(members[k]) for c in zip(*members[k], strict=True)) if k in members else e for k, e in enumerate(books[p])]
    want = []
    for vec_id, label, v in rows:
        found = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        want.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    got, found = codes.compressed(frame, "vec_id", ["label"])
    assert codes.digest(found) == hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_codes_of_few(spark):
    got, books = codes.compressed(spark.createDataFrame([(1, [0.5] * 8, 0, "", 0.0), (2, [0.5] * 8, 0, "", 0.0)], SCHEMA), "vec_id", [])
    assert [tuple(r) for r in got.orderBy("vec_id").collect()] == [(1, "00000000", 0), (2, "00000000", 0)] and len(books[0]) == 2
    got, books = codes.compressed(spark.createDataFrame([], SCHEMA), "vec_id", ["label"])
    assert got.columns == ["vec_id", "label", "code", "error"] and got.count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    uneven, _ = codes.compressed(spark.createDataFrame([(k, [k / 7] * 6, 0, "", 0.0) for k in range(9)], SCHEMA), "vec_id", [])
    assert {r["error"] for r in uneven.collect()} == {0} and codes.bounds(6) == [(0, 2), (2, 4), (4, 5), (5, 6)]


def test_large_entries_are_an_error(spark):
    with pytest.raises(Exception, match="below"):
        codes.compressed(spark.createDataFrame([(1, [1e30] * 8, 0, "", 0.0)], SCHEMA), "vec_id", [])[0].collect()


def test_lobpcg():
    r = np.random.default_rng(5)
    for n, spectrum in ((40, r.random(40)), (64, np.r_[5, 5, 5, np.full(61, 1.0)]), (120, 0.99 ** np.arange(120)), (3, [2, 1, 0]), (1, [4.0])):
        q = np.linalg.qr(r.normal(size=(n, n)))[0]
        a = (q * spectrum) @ q.T
        products = []
        values, x, residuals = whitening.lobpcg(lambda block, a=a, p=products: p.append(block.shape[1]) or a @ block, n, 8)
        assert np.allclose(values, np.sort(spectrum)[::-1][:8], atol=1e-12) and np.allclose(x.T @ x, np.eye(len(values)), atol=1e-12)
        assert np.abs(a @ x - x * values).max() < 1e-10 and max(products) <= 3 * (8 + whitening.GUARD)


def test_whitening(spark, frame):
    rows = [(i, [x + whitening.SHIFT for x in v]) for i, _, v in kept(table())]
    n = len(rows)
    total = [sum(v[d] for _, v in rows) for d in range(12)]
    y = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(v, total, strict=True)] for _, v in rows])
    cov = y.T @ y / n
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1][:8], directions[:, ::-1][:, :8]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(8)])
    want = sorted((str(i), sum((n * x - s) ** 2 for x, s in zip(v, total, strict=True)), *np.round(w, 6)) for (i, v), w in zip(rows, y @ directions / np.sqrt(values), strict=True))
    got, model = whitening.whitened(frame, ["vec_id"])
    found = sorted((str(r["vec_id"]), r["deviation"], *np.round(r["_w"], 6)) for r in got.collect())
    assert [x[:2] for x in found] == [x[:2] for x in want]
    assert np.allclose([x[2:] for x in found], [x[2:] for x in want], atol=3e-6)
    assert model["n"] == n and [int(s) for s in model["total"]] == total
    assert np.allclose(model["values"] / model["trace"], values / np.trace(cov), rtol=1e-12) and model["error"] < 1e-9 and model["residuals"].max() < 1e-11 * values[0]


def test_whitening_without_variance(spark):
    same = spark.createDataFrame([(k, [0.25, 0.5, -0.5], 0, "", 0.0) for k in range(4)], SCHEMA)
    got, model = whitening.whitened(same, ["vec_id"])
    assert [(r["deviation"], r["_w"]) for r in got.collect()] == [(0, [])] * 4 and model["error"] == 0
    got, model = whitening.whitened(spark.createDataFrame([], SCHEMA), ["vec_id"])
    assert got.count() == 0 and model["n"] == 0
    line = spark.createDataFrame([(k, [k / 8, k / 4, 1.0], 0, "", 0.0) for k in range(9)], SCHEMA)
    got, model = whitening.whitened(line, ["vec_id"])
    assert len(model["values"]) == 1 and {len(r["_w"]) for r in got.collect()} == {1}


def test_deviations_beyond_64_bits():
    big = np.array([[1 << 25, 0], [0, 0]])
    n = 1 << 34
    total = np.array([n // 2 * (1 << 25), 0], object)
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in big]
    assert whitening.deviations(big, n, total) == [v if v < 1 << 63 else None for v in exact]
    assert whitening.deviations(big, 2, np.array([1 << 25, 0], object)) == [1 << 50, 1 << 50]
    assert np.allclose(whitening.centred(big, n, total), [[1 << 24, 0], [-(1 << 24), 0]])


def test_sums(spark):
    x = np.arange(60, dtype=np.int64).reshape(3, 20)
    parts = spark.createDataFrame([tuple(r.values()) for _ in range(2) for r in vectors.rows_of(x, np.array([0, 2, 3])).to_pylist()], "key long, at long, s array<bigint>")
    found = vectors.collected(vectors.summed(parts, "decimal(38,0)"), 4, 20, object)
    assert (found[[0, 2, 3]].astype(int) == 2 * x).all() and not found[1].any()
    assert scratch.shared_dir(spark)
