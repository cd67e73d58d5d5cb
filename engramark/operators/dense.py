"""Dense vectors: packed rows, the nearest of all rows in blocks of queries, and all pairs above a cosine, exactly.

A packed row is (id, x): x holds the vector over its length as little-endian doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramark.operators.graph import reliable

#: Queries that one pass over all rows takes along, and rows of a block of the pair join.
QUERIES_AT_ONCE = 4096
BLOCK = 8192
#: Rows whose cosines with a block of queries are held at once, cosines of a meeting held at once, and rows that are dealt to their meetings at once.
AT_ONCE = 1024
CELLS = 1 << 20
DEALT = 4096
#: Pivots at most, and the rows that a pivot stands for.
PIVOTS = 256
ROWS_PER_PIVOT = 8192
#: Slack for rounding of cosines.
SLACK = 1e-9


def packed(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """(id, x) of rows (id, vector): of one id the first by value. A vector that is null, empty or of zeros, or has a null or non-finite entry, has no direction and goes."""
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(math.inf)))
    some = rows.where(F.col("id").isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda e: e != 0))
    whole = some.groupBy("id").agg(F.min(F.col(vector).cast("array<double>")).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum([len(v) for v in batch.column(1)])
            out = []
            for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
                v = values[a:b] / np.abs(values[a:b]).max()
                out.append((v / math.sqrt(float(v @ v))).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "x"])

    return whole.mapInArrow(run, whole.select("id").schema.add("x", "binary"))


def matrix(column) -> np.ndarray:
    """The vectors of a column of packed bytes, all of one length."""
    cells = [c if isinstance(c, bytes) else bytes(c) for c in (column.to_pylist() if hasattr(column, "to_pylist") else column)]
    return np.frombuffer(b"".join(cells), "<f8").reshape(len(cells), -1) if cells else np.zeros((0, 0))


def nearest(queries: DataFrame, rows: DataFrame, top: int = 1) -> DataFrame:
    """(query, id, cosine) of the ``top`` rows nearest to each query, of equal cosines (to 6 places) the smaller ids; a row isn't its own.

    Queries and rows are packed(). Blocks of about QUERIES_AT_ONCE queries, a bounded size, go to
    every task, which keeps each query's best ``top``; the tables are read once for each block.
    """
    kind = queries.select(F.col("id").alias("query")).schema.add("id", rows.schema["id"].dataType).add("cosine", "double")
    out = rows.sparkSession.createDataFrame([], kind)
    for given in blocks(queries):
        out = out.union(rows.select("id", "x").mapInArrow(_best_of(given, top), kind))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def blocks(queries: DataFrame) -> Iterator[Broadcast]:
    """Blocks of about QUERIES_AT_ONCE packed() queries, each (names, vectors) in the order of the names, broadcast."""
    spark = queries.sparkSession
    n = max(1, -(-queries.count() * 2 // QUERIES_AT_ONCE))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    for block in range(n):
        found = numbered.where(F.col("block") == block).select("id", "x").orderBy("id").collect()
        if found:
            yield spark.sparkContext.broadcast((np.array([r["id"] for r in found]), matrix([r["x"] for r in found])))


def _best_of(given, top: int):
    """Each query's best rows of a task: names are sorted, and so are the rows of a batch, so that the first of equal cosines has the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = given.value
        best: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            ids = np.array(batch.column(0).to_pylist())
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], matrix(batch.column(1))[order]
            for k in range(0, len(ids), AT_ONCE):
                some, cosines = ids[k : k + AT_ONCE], np.round(q @ x[k : k + AT_ONCE].T, 6)
                at = np.minimum(np.searchsorted(names, some), len(names) - 1)
                own = np.flatnonzero(names[at] == some)
                cosines[at[own], own] = -np.inf
                found = []
                for _ in range(min(top, len(some))):
                    first = cosines.argmax(1)
                    found.append((some[first], cosines[np.arange(len(q)), first]))
                    cosines[np.arange(len(q)), first] = -np.inf
                fresh = tuple(np.stack(c, axis=1) for c in zip(*found, strict=True))
                if best is None:
                    best = fresh
                else:
                    both = tuple(np.concatenate(c, axis=1) for c in zip(best, fresh, strict=True))
                    keep = np.lexsort((both[0], -both[1]), axis=1)[:, :top]
                    best = tuple(np.take_along_axis(c, keep, 1) for c in both)
        if best is not None:
            row, place = np.nonzero(np.isfinite(best[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names[row].tolist()), pa.array(best[0][row, place].tolist()), pa.array(best[1][row, place])], ["query", "id", "cosine"])

    return run


def _close(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row of a, row of b, cosine, number verified) of pairs with at least the threshold, in strips of a of which CELLS cosines are held.

    The leading dimensions come first: what the rest can add is at most the product of
    the rests' lengths, and only pairs that may still reach the threshold are verified.
    """
    head = max(1, min(a.shape[1] // 2, 16))
    rest = [np.sqrt(np.maximum(0, 1 - (m[:, :head] ** 2).sum(1))) for m in (a, b)]
    height = max(1, CELLS // max(1, len(b)))
    for k in range(0, len(a), height):
        part = a[k : k + height]
        most = rest[0][k : k + height, None] * rest[1][None]
        most += part[:, :head] @ b[:, :head].T
        may = most >= threshold - SLACK
        n = int(np.count_nonzero(may))
        if n * 16 > may.size:
            # Where many are left, all products together cost less than each on its own.
            cosines = np.matmul(part, b.T, out=most)
            may &= cosines >= threshold - SLACK
            i, j = np.nonzero(may)
            yield i + k, j, cosines[i, j], n
        else:
            i, j = np.nonzero(may)
            cosine = np.einsum("ij,ij->i", part[i], b[j])
            keep = cosine >= threshold - SLACK
            yield i[keep] + k, j[keep], cosine[keep], n


def _meetings(rows: DataFrame, threshold: float, by: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(blocks that meet, members): rows (id, n, _g, x, cell, one, other, side) of each meeting, and every row's class.

    Every vector belongs to its nearest pivot, by angle. One that is close to a vector
    of another pivot is not farther from that pivot than from its own by more than twice
    the threshold's angle, nor farther than the pivot's radius and that angle; only such
    cells it visits. Cells and their visitors are cut into blocks of about BLOCK rows, so that no
    task holds more than two, and dimensions are taken in the order of falling variance of the pivots.
    """
    spark = rows.sparkSession
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")
    rows = rows.withColumn("_g", group)
    classes = reliable(rows.groupBy("_g", "x").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    n = classes.count()
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, -(-n // ROWS_PER_PIVOT)))).select("x").collect()
    centres = matrix([r["x"] for r in chosen])
    moments = centres.var(0) if len(centres) > 1 else np.zeros(centres.shape[1])
    order = np.argsort(-moments, kind="stable")
    given = spark.sparkContext.broadcast((centres, order))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, turn = given.value
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                angles = np.arccos(np.clip(x @ pivots.T, -1, 1))
                home = angles.argmin(1)
                cells = [c.tobytes() for c in np.ascontiguousarray(x[:, turn])]
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(cells, pa.binary()), pa.array(home.astype(np.int32)), pa.array(angles.min(1)), pa.array([a.tobytes() for a in angles], pa.binary())], ["id", "n", "_g", "x", "home", "angle", "angles"])

    kind = classes.select("id", "n", "_g").schema.add("x", "binary").add("home", "integer").add("angle", "double").add("angles", "binary")
    at_home = reliable(classes.select("x", "id", "n", "_g").mapInArrow(placed, kind))
    radius, size = np.full(len(centres), -np.inf), np.zeros(len(centres), int)
    for r in at_home.groupBy("home").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():
        radius[r["home"]], size[r["home"]] = r["radius"], r["n"]
    limits = spark.sparkContext.broadcast(radius)

    def visited(angles: np.ndarray, home: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a vector visits a cell: only such of higher numbers, as the others visit its own."""
        near = (angles <= limits.value[None] + reach + SLACK) & (angles <= own[:, None] + 2 * reach + SLACK)
        return near & (np.arange(angles.shape[1])[None] > home[:, None])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(limits.value), np.int64)
        for batch in batches:
            if batch.num_rows:
                total += visited(matrix(batch.column(2)), batch.column(0).to_numpy(), batch.column(1).to_numpy()).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "n"])

    guests = np.zeros(len(centres), int)
    for r in at_home.select("home", "angle", "angles").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        guests[r["cell"]] = r["n"]
    cuts = spark.sparkContext.broadcast((np.maximum(1, -(-size // BLOCK)), np.maximum(1, -(-guests // BLOCK))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each meeting of blocks that a vector takes part in: (cell, one, other, side); a home block meets itself and later ones, and each block of guests."""
        blocks, chunks = cuts.value
        for batch in batches:
            if not batch.num_rows:
                continue
            home, own, angles, h = batch.column(4).to_numpy(), batch.column(5).to_numpy(), matrix(batch.column(6)), batch.column(7).to_numpy()
            guest = visited(angles, home, own)
            out: list[tuple] = []
            for k in range(batch.num_rows):
                c = int(home[k])
                mine = int(h[k] % blocks[c])
                out += [(k, c, mine, t, 0) for t in range(mine, blocks[c])] + [(k, c, t, mine, 1) for t in range(mine)]
                if guests[c]:
                    out += [(k, c, mine, -1 - t, 0) for t in range(chunks[c])]
                for d in np.flatnonzero(guest[k]):
                    chunk = -1 - int((h[k] // 7919) % chunks[d])
                    out += [(k, int(d), t, chunk, 1) for t in range(blocks[d])]
                if len(out) >= DEALT or k + 1 == batch.num_rows:
                    at, *cells = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(4)), *(pa.array(c, pa.int32()) for c in cells)], ["id", "n", "_g", "x", "cell", "one", "other", "side"])
                    out = []

    meetings = at_home.withColumn("h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 40))).mapInArrow(dealt, classes.select("id", "n", "_g").schema.add("x", "binary").add("cell", "integer").add("one", "integer").add("other", "integer").add("side", "integer"))

    return meetings, rows.join(classes.withColumnRenamed("id", "class"), ["_g", "x"]).select("id", "class")


def _met(pdf: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row of one, row of the other, cosine, verified) of the close pairs of one meeting, strip by strip."""
    side, x = pdf["side"].to_numpy(), matrix(pdf["x"])
    same = pdf["one"].iloc[0] == pdf["other"].iloc[0]
    a, b = (np.flatnonzero(side == 0),) * 2 if same else (np.flatnonzero(side == k) for k in (0, 1))
    total = 0
    for i, j, cosine, verified in _close(x[a], x[b], threshold):
        total += verified
        if same:
            keep = i < j
            i, j, cosine = i[keep], j[keep], cosine[keep]
        yield a[i], b[j], cosine, 0
    none = np.zeros(0, int)
    yield none, none, np.zeros(0), (total - len(a)) // 2 if same else total


def pairs(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((u, v, cosine), (id, class), counts): all pairs u < v of classes with at least the threshold, exactly, and every row's class.

    Only rows with equal values of the columns ``by`` meet, and null is one of them. A class
    is the rows of one vector, by its least id; expanded() makes pairs of rows. counts has one
    row: verified, the pairs whose whole cosine was computed.
    """
    key = rows.schema["id"].dataType
    meetings, members = _meetings(rows, threshold, by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        ids = pdf["id"].to_numpy()
        for i, j, cosine, verified in _met(pdf, threshold):
            u, v = ids[i], ids[j]
            swap = u > v
            ends = [np.where(swap, x, y) for x, y in ((v, u), (u, v))]
            yield pd.DataFrame({"u": ends[0], "v": ends[1], "cosine": cosine, "verified": np.zeros(len(i), np.int64)})
            if verified:
                # A row that has the count alone.
                yield pd.DataFrame({"u": pd.Series([None], dtype=object), "v": pd.Series([None], dtype=object), "cosine": [0.0], "verified": [verified]})

    schema = T.StructType().add("u", key).add("v", key).add("cosine", "double").add("verified", "long")
    found = reliable(meetings.groupBy("_g", "cell", "one", "other").applyInPandas(run, schema))
    counts = found.agg(F.coalesce(F.sum("verified"), F.lit(0)).alias("verified"))
    return found.where("u is not null").select("u", "v", "cosine"), members, counts


def links(rows: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(id, near, most): how many other rows have at least the threshold with each row, and the highest cosine; rows without any are left out.

    As pairs(), but every meeting gives a row for each of its vectors, not for each pair.
    """
    meetings, members = _meetings(rows, threshold, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = pdf["id"].to_numpy(), pdf["n"].to_numpy()
        near, most = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        for i, j, cosine, _ in _met(pdf, threshold):
            for a, b in ((i, j), (j, i)):
                np.add.at(near, a, sizes[b])
                np.maximum.at(most, a, cosine)
        some = near > 0
        return pd.DataFrame({"class": ids[some], "near": near[some], "most": most[some]})

    schema = members.select("class").schema.add("near", "long").add("most", "double")
    found = meetings.groupBy("_g", "cell", "one", "other").applyInPandas(run, schema)
    own = members.groupBy("class").agg((F.count("*") - 1).alias("near")).where("near > 0").withColumn("most", F.lit(1.0))
    of_class = found.unionByName(own).groupBy("class").agg(F.sum("near").alias("near"), F.max("most").alias("most"))
    return members.join(of_class, "class").select("id", "near", "most")


def expanded(between: DataFrame, members: DataFrame) -> DataFrame:
    """pairs() of classes as pairs of rows, with those inside each class: as many as there are."""
    one = between.join(members.select(F.col("id").alias("a"), F.col("class").alias("u")), "u").join(members.select(F.col("id").alias("b"), F.col("class").alias("v")), "v")
    a, b = members.alias("a"), members.alias("b")
    inside = a.join(b, (F.col("a.class") == F.col("b.class")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.lit(1.0).alias("cosine"))
    return one.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "cosine").union(inside)
