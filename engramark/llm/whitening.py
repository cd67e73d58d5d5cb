"""Whitening of vectors along their leading principal components, found by LOBPCG.

The covariance matrix is never formed: it is applied to a block of directions by
one pass over the centred rows, whose partial products Spark adds up. Each round
solves the problem within the span of the block's iterate, its residual and its
previous direction (Rayleigh-Ritz), until the residuals certify the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramark.llm import scratch, vectors

COMPONENTS = 8
#: Directions beyond the components that the block holds, so that the last components converge as fast as the first.
GUARD = 8
#: What is added to the integers.
SHIFT = 100_000
#: A component is certified once its residual is below this part of the largest eigenvalue.
RESIDUAL = 1e-13
#: Residuals that no longer fall are at the rounding of the products; they certify up to this part.
ROUNDING = 1e-11
ROUNDS = 300
#: A direction with less than this part of the total variance has none: it can't be whitened and is no component.
NO_VARIANCE = 1e-12


def totals(x: DataFrame, length: int) -> tuple[int, np.ndarray]:
    """(n, S): the number of rows ``_x`` and the exact sums of their dimensions, as Python integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += vectors.matrix(batch.column(0), length).sum(0)
        if n:
            yield vectors.rows_of(np.append(total, n)[None, :], np.zeros(1, np.int64))

    parts = x.select("_x").mapInArrow(run, "key long, at long, s array<bigint>")
    found = vectors.collected(vectors.summed(parts, "decimal(38,0)"), 1, length + 1, object)[0]
    return int(found[-1]), np.array([int(s) for s in found[:-1]], object)


def centred(ints: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n of integer rows: exact up to one rounding where n x - S fits 64 bits, else from the nearest integer of the mean."""
    if n * (int(np.abs(ints).max(initial=0)) + 1) < 1 << 62:
        return (n * ints - total.astype(np.int64)) / n
    near = np.array([int(s) // n for s in total], np.int64)
    rest = np.array([(int(s) - int(m) * n) / n for s, m in zip(total, near, strict=True)])
    return (ints - near) - rest


def product(x: DataFrame, length: int, n: int, total: np.ndarray, block: np.ndarray) -> np.ndarray:
    """V block, V the covariance (divisor n) of the rows ``_x``: one pass, in which each task adds up y (y' block) over its centred rows y."""
    given = x.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(given.value.shape), False
        for batch in batches:
            y = centred(vectors.matrix(batch.column(0), length), n, total)
            out += y.T @ (y @ given.value)
            some |= len(y) > 0
        if some:
            yield vectors.rows_of(out, np.arange(length))

    parts = x.select("_x").mapInArrow(run, "key long, at long, s array<double>")
    return vectors.collected(vectors.summed(parts, "double"), length, block.shape[1], float) / n


def variance(x: DataFrame, length: int, n: int, total: np.ndarray) -> float:
    """The trace of the covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(float((centred(vectors.matrix(b.column(0), length), n, total) ** 2).sum()) for b in batches)])], ["v"])

    return (x.select("_x").mapInArrow(run, "v double").agg(F.sum("v").alias("v")).first()["v"] or 0.0) / n


def _orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of the blocks' columns, the first block's own first; columns that the others already span are left out."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        for column in block.T:
            size = np.linalg.norm(column)
            if size and basis.shape[1] < len(column):
                now = column / size
                for _ in range(2):
                    now = now - basis @ (basis.T @ now)
                left = np.linalg.norm(now)
                if left > 1e-8:
                    now = now / left
                    now -= basis @ (basis.T @ now)
                    basis = np.column_stack([basis, now / np.linalg.norm(now)])
    return basis


def lobpcg(apply, length: int, components: int, guard: int = GUARD, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, residuals) of the largest ``components`` of a symmetric operator, by falling eigenvalue.

    ``apply`` gives the operator's product with a block. Of equal eigenvalues any basis
    of their space is right. An eigenvector's largest entry is positive. A block that the
    rounds don't certify is an error.
    """
    size, wanted = min(length, components + guard), min(length, components)
    x = np.linalg.qr(np.random.default_rng(0).normal(size=(length, size)))[0]
    residual = direction = np.zeros((length, 0))
    least, since = np.inf, 0
    for _ in range(rounds):
        basis = _orthonormal([x, residual, direction])
        image = apply(basis)
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:size], turn[:, ::-1][:, :size]
        after, residual = basis @ turn, image @ turn - (basis @ turn) * values
        direction = after - x @ (x.T @ after)
        x = after
        sizes = np.linalg.norm(residual[:, :wanted], axis=0)
        worst, top = sizes.max(initial=0.0), max(values[0], 0.0)
        since, least = (0, worst) if worst < least / 2 else (since + 1, least)
        if worst <= RESIDUAL * top or (since >= 4 and worst <= ROUNDING * top):
            break
    else:
        raise ArithmeticError(f"residual {worst} after {rounds} rounds, largest eigenvalue {top}")
    x = x[:, :wanted]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(wanted)] < 0, -1.0, 1.0)
    return values[:wanted], x, sizes


def deviations(ints: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sums of (n x - S)**2 over each row's dimensions, exact; null where one doesn't fit 64 bits."""
    most = n * (int(np.abs(ints).max(initial=0)) + 1) + max((abs(int(s)) for s in total), default=0)
    if most * most * max(1, ints.shape[1]) < 1 << 63:
        return ((n * ints - total.astype(np.int64)) ** 2).sum(1).tolist()
    if most < 1 << 63:
        # The bound above is wide of most rows.
        off = np.abs(n * ints - total.astype(np.int64))
        if int(off.max(initial=0)) ** 2 * ints.shape[1] < 1 << 63:
            return (off**2).sum(1).tolist()
    exact = [sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in ints]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(table: DataFrame, keep: list[str], vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """(keep and deviation, _w of each usable row, the model).

    ``_w`` holds the centred row projected on each component over the component's standard
    deviation; the model has n, total (S), values, components, residuals, trace and error,
    the largest absolute entry of the covariance of ``_w`` minus the identity. See
    vectors.usable() for rows that go. An empty table gives no rows, repeated rows
    give repeated results. Fewer dimensions than ``components``, or fewer that vary,
    give fewer components; a single row, or equal ones, none: their ``_w`` is empty.
    """
    spark = table.sparkSession
    rows, length = vectors.usable(table, vector, keep)
    x = scratch.written(vectors.packed(rows, length, SHIFT), "integers")
    n, total = totals(x, length)
    trace = variance(x, length, n, total) if n else 0.0
    if trace > 0:
        values, directions, residuals = lobpcg(lambda block: product(x, length, n, total, block), length, components)
        some = values > NO_VARIANCE * trace
        values, directions, residuals = values[some], directions[:, some], residuals[some]
    else:
        values, directions, residuals = np.zeros(0), np.zeros((length, 0)), np.zeros(0)
    given = spark.sparkContext.broadcast(directions / np.sqrt(values))
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = vectors.matrix(batch.column(batch.num_columns - 1), length)
            w = centred(ints, n, total) @ given.value
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(deviations(ints, n, total), pa.int64()), lists], [*keep, "deviation", "_w"])

    out = scratch.written(x.mapInArrow(run, x.drop("_x").schema.add("deviation", "long").add("_w", T.ArrayType(T.DoubleType()))), "whitened")
    return out, {"n": n, "total": total, "values": values, "components": directions, "residuals": residuals, "trace": trace, "error": identity_error(out, k) if k else 0.0}


def identity_error(rows: DataFrame, k: int) -> float:
    """The largest absolute entry of the covariance of ``_w`` (divisor n, centred before multiplying) minus the identity."""

    def gathered(centre: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, out = 0, np.zeros((k + 1, k))
            for batch in batches:
                w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                n += len(w)
                if centre is None:
                    out[0] += w.sum(0)
                else:
                    out[:k] += (w - centre).T @ (w - centre)
            out[k] = n
            yield vectors.rows_of(out, np.arange(k + 1))

        parts = rows.select("_w").mapInArrow(run, "key long, at long, s array<double>")
        return vectors.collected(vectors.summed(parts, "double"), k + 1, k, float)

    first = gathered(None)
    second = gathered(first[0] / first[k])
    return float(np.abs(second[:k] / second[k] - np.eye(k)).max())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component up to 8. Nulls, empty tables, ties and repeats are as whitened() says."""
    rows, model = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), ["vec_id"])
    shares = F.array(*(F.lit(float(v / model["trace"])) for v in model["values"])) if len(model["values"]) else F.array().cast("array<double>")
    exploded = rows.select("vec_id", "deviation", F.posexplode("_w").alias("_k", "whitened"))
    return exploded.select("vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("_k") + 1).alias("explained"), F.lit(float(model["error"])).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
