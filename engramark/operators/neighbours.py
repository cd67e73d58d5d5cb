"""Approximate nearest neighbours through a navigable graph: an adjacency table, built by neighbour descent and searched by rounds of frontier joins.

Rows are dense.packed(). Every round of the descent introduces the neighbours of each
node to one another and keeps each node's nearest; every round of a search opens the
best nodes of each query that aren't open yet. Both are joins on node ids, whose
groups hold a bounded number of nodes.

parted() is the index to search many rows by: every row belongs to one part of about PART
rows, each part has a graph of its own, and a search goes through the graphs of all
parts, each in one task. Its rounds are steps over arrays instead of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from engramark.operators import dense
from engramark.operators.graph import reliable

#: Nearest neighbours that a node keeps, and links that it has at random.
DEGREE = 16
RANDOM = 4
#: Random groupings that the first neighbours come from.
GROUPINGS = 4
#: Rounds of descent at most; it ends when fewer than this part of all links are new.
DESCENTS = 8
SETTLED = 0.01
#: Nodes that a search holds and opens at once for each query, nodes that all searches start from, and rounds at most.
BEAM = 64
OPENED = 12
ENTRIES = 32
ROUNDS = 200
#: Rows of a part of a parted index, and pairs of a query and a node of a part whose vectors are held at once.
PART = 16384
DEALT = 16384
#: Up to so many rows the exact search is taken.
LINEAR = 5000
#: The recall that a search must have.
LEAST = 0.9


def _small(rows: DataFrame) -> DataFrame:
    """rows (id, x) with single-precision vectors, half as long: enough to build links by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense.matrix(batch.column(1)).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])

    return rows.select("id", "x").mapInArrow(run, rows.select("id", "x").schema)


def _met(at: np.ndarray, ids: np.ndarray, x: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(u, v, cosine) of every group of successive equal ``at``: of each of its nodes the DEGREE nearest, where one of the two is fresh."""
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(at)], strict=True):
        if b - a < 2 or not fresh[a:b].any():
            continue
        cosines = x[a:b] @ x[a:b].T
        cosines[~(fresh[a:b, None] | fresh[None, a:b])] = -2
        cosines[np.arange(b - a), np.arange(b - a)] = -2
        most = min(DEGREE, b - a - 1)
        best = np.argpartition(-cosines, most - 1, axis=1)[:, :most]
        found = np.take_along_axis(cosines, best, 1)
        row, place = np.nonzero(found > -1.5)
        yield ids[a:b][row], ids[a:b][best[row, place]], found[row, place]


def _introduced(members: DataFrame, schema) -> DataFrame:
    """(u, v, cosine) of the nodes that meet at a key (at, id, x, fresh), in both directions: each node's DEGREE nearest of those met, one of the two fresh at least.

    Rows of a key are neighbours in the sorted partitions, so that a task goes through batches of many small groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in _with_end(batches):
            if batch is not None:
                left = batch if left is None else pa.concat_batches([left, batch])
                at = left.column(0).to_pylist()
                whole = len(at) - 1
                while whole >= 0 and at[whole] == at[-1]:
                    whole -= 1
                part, left = left.slice(0, whole + 1), left.slice(whole + 1)
            else:
                part = left
            if part is None or not part.num_rows:
                continue
            at, ids = (np.array(part.column(c).to_pylist()) for c in (0, 1))
            x = np.frombuffer(b"".join(part.column(2).to_pylist()), "<f4").reshape(part.num_rows, -1)
            found = [*_met(at, ids, x, np.array(part.column(3).to_pylist(), bool))]
            if found:
                u, v, c = (np.concatenate(k) for k in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u.tolist(), part.schema.field(1).type), pa.array(v.tolist(), part.schema.field(1).type), pa.array(c.astype(float))], ["u", "v", "cosine"])

    return members.select("at", "id", "x", "fresh").repartition("at").sortWithinPartitions("at", "id").mapInArrow(run, schema)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _nearest(links: DataFrame, most: int, end: str = "u", other: str = "v") -> DataFrame:
    """Each node's ``most`` nearest links; Spark drops the others of a node before it shuffles, so that a hub isn't one task's."""
    order = Window.partitionBy(end).orderBy(F.desc("cosine"), other)
    return links.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")


def graph(rows: DataFrame, degree: int = DEGREE, descents: int = DESCENTS) -> DataFrame:
    """(id, x, links): the adjacency table of packed rows.

    A node's links are its nearest nodes as far as the descent found them, the nearest
    of those that link to it, and some at random, over which a search leaves a cluster. The
    first neighbours are the nearest in random groups. A single row has no links.
    """
    rows = reliable(rows.select("id", "x"))
    n = rows.count()
    small = reliable(_small(rows))
    schema = rows.select(F.col("id").alias("u"), F.col("id").alias("v")).schema.add("cosine", "double")
    groups = max(1, n // (2 * degree))

    def grouped(seed: int) -> DataFrame:
        return small.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(groups)).alias("at"), "id", "x", F.lit(True).alias("fresh"))

    # From one grouping alone neighbours of neighbours would stay in their group.
    starts = [_nearest(_introduced(grouped(seed), schema), max(1, degree // 2)) for seed in range(GROUPINGS)]
    links = reliable(_nearest(reduce(DataFrame.union, starts).distinct(), degree).withColumn("fresh", F.lit(True)))
    for _ in range(descents):
        # A node's own neighbours and the nearest of those that have it as one.
        back = _nearest(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine", "fresh"), degree)
        ends = links.unionByName(back).groupBy("u", "v").agg(F.bool_or("fresh").alias("fresh"))
        active = ends.groupBy("u").agg(F.bool_or("fresh").alias("any")).where("any").select("u")
        met = ends.join(active, "u", "left_semi").join(small.withColumnRenamed("id", "v"), "v").select(F.col("u").alias("at"), F.col("v").alias("id"), "x", "fresh")
        found = _introduced(met, schema).withColumn("fresh", F.lit(True)).unionByName(links.withColumn("fresh", F.lit(False)))
        # A link that was there is not fresh.
        once = found.groupBy("u", "v").agg(F.max("cosine").alias("cosine"), F.bool_and("fresh").alias("fresh"))
        links = reliable(_nearest(once, degree))
        if links.where("fresh").count() <= SETTLED * degree * n:
            break
    back = _nearest(links.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"), degree)
    chance = _random_links(grouped(GROUPINGS))
    every = links.select("u", "v").union(back.select("u", "v")).union(chance).distinct().groupBy("u").agg(F.collect_list("v").alias("links"))
    return reliable(rows.join(every, rows["id"] == every["u"], "left").select("id", "x", F.coalesce("links", F.array().cast(every.schema["links"].dataType)).alias("links")))


def _random_links(groups: DataFrame) -> DataFrame:
    """(u, v): every node with the RANDOM next of its group, in the order of their hashes."""
    order = Window.partitionBy("at").orderBy(F.xxhash64("id", F.lit(3)), "id")
    after = groups.select("at", "id", *(F.lead("id", k).over(order).alias(f"n{k}") for k in range(1, RANDOM + 1)))
    return after.select(F.col("id").alias("u"), F.explode(F.array_compact(F.array(*(f"n{k}" for k in range(1, RANDOM + 1))))).alias("v"))


def parted(rows: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(part, id, x, links): the adjacency table of packed rows that are dealt to parts of about PART rows by their hashes, with links inside each part.

    A node's links are its nearest nodes of its part, exactly, the nearest of those that
    link to it, and the next in a ring through all of the part in random order, so that every
    node is reached from every other. A row of a part alone has no links.
    """
    rows = reliable(rows.select("id", "x"))
    parts = max(1, -(-rows.count() // PART))
    dealt = rows.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(parts)).cast("int").alias("part"), "id", "x")

    def run(part: pa.Table) -> pa.Table:
        part = part.take(pa.array(np.argsort(_column(part, "id"), kind="stable")))
        links = _linked(dense.matrix(part.column("x")).astype("<f4"), degree)
        real = links < part.num_rows
        ends = np.r_[0, np.cumsum(real.sum(1))].astype(np.int32)
        ids = part.column("id").combine_chunks().take(pa.array(links[real]))
        return part.append_column("links", pa.ListArray.from_arrays(pa.array(ends), ids))

    kind = T.StructType([*dealt.schema, T.StructField("links", T.ArrayType(rows.schema["id"].dataType))])
    return reliable(dealt.groupBy("part").applyInArrow(run, kind))


def _column(part: pa.Table, name: str) -> np.ndarray:
    return np.array(part.column(name).to_pylist())


def _linked(x: np.ndarray, degree: int) -> np.ndarray:
    """The links of every row of a part in a row of positions, filled up with the number of rows."""
    n = len(x)
    near = min(degree, n - 1)
    best, cosine = np.zeros((n, near), np.int64), np.zeros((n, near), x.dtype)
    height = max(1, dense.CELLS // n)
    for a in range(0, n if near else 0, height):
        cosines = x[a : a + height] @ x.T
        at = np.arange(len(cosines))
        cosines[at, at + a] = -2
        best[a : a + height] = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
        cosine[a : a + height] = np.take_along_axis(cosines, best[a : a + height], 1)
    u, v = np.repeat(np.arange(n), near), best.ravel()
    # Of those that link to a node the nearest.
    order = np.lexsort((u, -cosine.ravel(), v))
    back = order[_rank(v[order]) < degree]
    ring = np.random.default_rng(3).permutation(n)
    steps = range(1, min(RANDOM, n - 1) + 1)
    ends = np.concatenate([u, v[back], *(ring for _ in steps)]), np.concatenate([v, u[back], *(np.roll(ring, -k) for k in steps)])
    key = np.unique(ends[0] * n + ends[1])
    u, v = key // n, key % n
    out = np.full((n, 2 * degree + RANDOM), n, np.int64)
    out[u, _rank(u)] = v
    return out


def _rank(groups: np.ndarray) -> np.ndarray:
    """The place of each entry in its group; equal groups are next to one another."""
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def _walked(q: np.ndarray, x: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, cosines) of the ``beam`` nodes nearest to each query that a search through the links of a part finds, the nearest first; len(x) where there are fewer.

    All queries go on together, a round opens some nodes of each.
    """
    n, beam = len(x), min(beam, len(x))
    at, cosine, closed = np.full((len(q), beam), n), np.full((len(q), beam), -np.inf), np.zeros((len(q), beam), bool)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    entries = np.random.default_rng(4).permutation(n)[:ENTRIES]
    row, node = np.repeat(np.arange(len(q)), len(entries)), np.tile(entries, len(q))
    opened = max(OPENED, beam // 5)
    while True:
        seen[row, node] = True
        fresh = np.zeros(len(row))
        for a in range(0, len(row), DEALT):
            fresh[a : a + DEALT] = np.einsum("ij,ij->i", q[row[a : a + DEALT]], x[node[a : a + DEALT]])
        better = fresh > cosine[row, -1]
        row, node, fresh = row[better], node[better], fresh[better]
        # Only queries that gained a node are put in order anew.
        some, place = np.unique(row, return_inverse=True)
        rows = np.r_[np.repeat(np.arange(len(some)), beam), place]
        nodes, cosines, done = np.r_[at[some].ravel(), node], np.r_[cosine[some].ravel(), fresh], np.r_[closed[some].ravel(), np.zeros(len(row), bool)]
        order = np.lexsort((nodes, -cosines, rows))
        order = order[_rank(rows[order]) < beam]
        at[some], cosine[some], closed[some] = (c[order].reshape(len(some), beam) for c in (nodes, cosines, done))
        waiting = ~closed & (at < n)
        if not waiting.any():
            break
        now = waiting & (np.cumsum(waiting, axis=1) <= opened)
        closed |= now
        row, place = np.nonzero(now)
        reached = links[at[row, place]]
        row, node = np.repeat(row, links.shape[1]), reached.ravel()
        unseen = ~seen[row, node]
        key = np.unique(row[unseen] * (n + 1) + node[unseen])
        row, node = key // (n + 1), key % (n + 1)
    return at, cosine


def _through_parts(queries: DataFrame, index: DataFrame, top: int, beam: int) -> DataFrame:
    """(query, id, cosine): what searches through all parts of a parted() index find, the best ``top``; blocks of queries go to every part."""
    kind = queries.select(F.col("id").alias("query")).schema.add("id", index.schema["id"].dataType).add("cosine", "double")
    out = queries.sparkSession.createDataFrame([], kind)
    for given in dense.blocks(queries):
        out = out.union(index.groupBy("part").applyInArrow(_best_of_part(given, top, beam, to_arrow_schema(kind)), kind))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def _best_of_part(given: Broadcast, top: int, beam: int, form: pa.Schema):
    """Each query's best rows of a part as far as a search finds them."""

    def run(part: pa.Table) -> pa.Table:
        names, q = given.value
        order = np.argsort(_column(part, "id"), kind="stable")
        ids, x = _column(part, "id")[order], dense.matrix(part.column("x"))[order]
        lists = part.column("links").combine_chunks().take(pa.array(order))
        sizes = np.array(lists.value_lengths().to_pylist())
        links = np.full((len(ids), max(1, sizes.max())), len(ids))
        of = np.repeat(np.arange(len(ids)), sizes)
        links[of, _rank(of)] = np.searchsorted(ids, np.array(lists.flatten().to_pylist(), ids.dtype))
        found = []
        step = max(1, dense.CELLS // len(ids))
        for a in range(0, len(names), step):
            at, cosine = _walked(q[a : a + step], x, links, beam)
            row, place = np.nonzero(at < len(ids))
            node, cosine = at[row, place], cosine[row, place]
            other = names[a + row] != ids[node]
            row, node, cosine = row[other], node[other], cosine[other]
            order = np.lexsort((node, -np.round(cosine, 6), row))
            order = order[_rank(row[order]) < top]
            found.append((names[a + row[order]], ids[node[order]], cosine[order]))
        return pa.table([pa.array(np.concatenate(c).tolist(), f.type) for c, f in zip(zip(*found, strict=True), form, strict=True)], schema=form)

    return run


def _cosines(pairs: DataFrame, kind) -> DataFrame:
    """(query, id, cosine) of rows (query, id, q, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, x = dense.matrix(batch.column(2)), dense.matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.einsum("ij,ij->i", q, x) if len(q) else np.zeros(0))], ["query", "id", "cosine"])

    return pairs.select("query", "id", "q", "x").mapInArrow(run, kind)


def searched(queries: DataFrame, index: DataFrame, top: int = 1, beam: int = BEAM) -> DataFrame:
    """(query, id, cosine): the ``top`` nodes nearest to each query as far as a search through graph() or parted() finds them; a row isn't its own.

    In each part of a parted() index ``beam`` nodes a query are held, and the best of all parts are
    taken. Through graph() the state is a table of ``beam`` nodes a query. Frontiers are joined with the
    adjacency table by node; Spark broadcasts them only while they are small. A search ends when
    every node that it holds is open. Of equal cosines (to 6 places) the smaller ids come first.
    """
    if "part" in index.columns:
        return _through_parts(queries, index, top, beam)
    kind = queries.select(F.col("id").alias("query")).schema.add("id", index.schema["id"].dataType).add("cosine", "double")
    asked = reliable(queries.select(F.col("id").alias("query"), F.col("x").alias("q")))
    entries = index.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(ENTRIES).select("id", "x")
    # The entries are few, so that each query meets each of them.
    state = _cosines(asked.join(F.broadcast(entries)), kind).withColumn("open", F.lit(False))
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    closed = F.count_if(~F.col("open")).over(best)

    def held(nodes: DataFrame) -> DataFrame:
        """Each query's best nodes, with now: those that are to be opened next."""
        x = nodes.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= beam)
        return reliable(x.select("query", "id", "cosine", "open", (~F.col("open") & (closed <= OPENED)).alias("now")))

    state = held(state)
    for _ in range(ROUNDS):
        frontier = state.where("now").select("query", "id")
        if frontier.isEmpty():
            break
        reached = frontier.join(index.select("id", "links"), "id").select("query", F.explode("links").alias("id")).distinct()
        fresh = reached.join(state.select("query", "id"), ["query", "id"], "left_anti").join(index.select("id", "x"), "id").join(asked, "query")
        opened = state.select("query", "id", "cosine", (F.col("open") | F.col("now")).alias("open"))
        state = held(opened.unionByName(_cosines(fresh, kind).withColumn("open", F.lit(False))))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")
    return state.where("query <> id").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).select("query", "id", "cosine")


def enough(queries: DataFrame, index: DataFrame, truth: DataFrame, top: int, least: float = LEAST) -> tuple[DataFrame, float]:
    """What a search finds, and its recall of the truth: the beam is doubled until the recall is ``least``, at the latest when it holds all nodes."""
    n, beam = index.count(), max(BEAM, top)
    while True:
        found = reliable(searched(queries, index, top, beam))
        share = recall(found, truth).first()["recall"]
        if share is None or share >= least or beam > n:
            return found, share
        beam *= 2


def checked(found: DataFrame, queries: DataFrame, rows: DataFrame, top: int = 1) -> DataFrame:
    """What a search found after an exact check against all rows, in blocks of queries: rows that it missed take the places of lesser ones."""
    every = found.unionByName(dense.nearest(queries, rows, top)).groupBy("query", "id").agg(F.max("cosine").alias("cosine"))
    order = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 6)), "id")
    return every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def nearest(queries: DataFrame, rows: DataFrame, top: int = 1, backend: str = "auto") -> DataFrame:
    """(query, id, cosine) by the ``backend``: linear (exact, in blocks), graph (a parted() index), or auto, which takes the graph for more than LINEAR rows."""
    if backend not in ("linear", "graph", "auto"):
        raise ValueError(f"no backend {backend!r}")
    if backend == "linear" or (backend == "auto" and rows.count() <= LINEAR):
        return dense.nearest(queries, rows, top)
    return searched(queries, parted(rows), top)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: queries and hits, the share of whose true nearest rows were found. Both tables are (query, id, cosine); an equally near row is a hit."""
    least = truth.groupBy("query").agg(F.min(F.round("cosine", 6)).alias("least"), F.count("*").alias("n"))
    hit = found.join(least, "query").where(F.round("cosine", 6) >= F.col("least")).groupBy("query").agg(F.count("*").alias("k"))
    x = least.join(hit, "query", "left")
    return x.agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("k", F.lit(0)), F.col("n"))) / F.sum("n")).alias("recall"))
