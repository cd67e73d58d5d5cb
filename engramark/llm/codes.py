"""Product quantisation of vectors: codebooks by Lloyd rounds, assignment by partial-distance search.

A search goes through the dimensions in the order of falling codebook variance and
drops an entry from a part's candidates once its accumulated integer distance
strictly exceeds the best complete distance so far; the nearest entry, of equal ones
the lower, is never dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import scratch, vectors

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Rows that are searched at once, and the dimensions after which candidates are dropped for the first time.
AT_ONCE = 2048
FIRST = 2
#: Dimensions between two tightenings of the best complete distance.
TIGHTEN = 4


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """(start, end) of consecutive parts, equal if ``parts`` divides the length; else the first ones are longer by one."""
    sizes = [length // parts + (p < length % parts) for p in range(parts)]
    return [(sum(sizes[:p]), sum(sizes[: p + 1])) for p in range(parts)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest row of ``book`` for each row of ``x``, of equally near ones the lower; all integers."""
    if not len(x) or not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    reach = int(np.abs(x).max()) + int(np.abs(book).max())
    kind = np.int32 if reach * reach * x.shape[1] < 1 << 31 else np.int64
    centre = book - book.mean(0)
    order = np.argsort(-(centre * centre).sum(0), kind="stable")
    x, book = np.ascontiguousarray(x[:, order], kind), np.ascontiguousarray(book[:, order], kind)
    index, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), AT_ONCE):
        index[at : at + AT_ONCE], distance[at : at + AT_ONCE] = _search(x[at : at + AT_ONCE], book)
    return index, distance


def _search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, width = x.shape
    first = min(FIRST, width)
    sums = np.zeros((n, len(book)), x.dtype)
    for d in range(first):
        apart = x[:, d, None] - book[None, :, d]
        sums += apart * apart
    best = ((x - book[sums.argmin(1)]) ** 2).sum(1, dtype=x.dtype)
    row, entry = np.nonzero(sums <= best[:, None])
    sums = sums[row, entry]
    for d in range(first, width):
        apart = x[row, d] - book[entry, d]
        sums += apart * apart
        if (d - first) % TIGHTEN == TIGHTEN - 1 and d + 1 < width:
            # Candidates are in the order of rows: the leading one of each row gets its complete distance.
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            leading = np.flatnonzero(sums == np.repeat(np.minimum.reduceat(sums, start), np.diff(np.r_[start, len(row)])))
            whole = ((x[row[leading]] - book[entry[leading]]) ** 2).sum(1, dtype=x.dtype)
            np.minimum.at(best, row[leading], whole)
        stay = sums <= best[row]
        row, entry, sums = row[stay], entry[stay], sums[stay]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, start)
    ties = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[start, len(row)])))
    lowest = ties[np.r_[True, row[ties][1:] != row[ties][:-1]]]
    return entry[lowest], least


def first_books(rows: DataFrame, id: str, length: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors with the ``entries`` smallest ids, ascending; null ids come last, equal ids by their vectors."""
    found = rows.select(id, "_x").orderBy(F.asc_nulls_last(id), "_x").limit(entries).collect()
    whole = np.array([np.frombuffer(r["_x"], "<i8") for r in found], np.int64).reshape(len(found), length)
    return [whole[:, a:b] for a, b in bounds(length, parts)]


def renewed(x: DataFrame, length: int, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: every entry the floor of its parts' mean; one without parts stays."""
    cuts, entries = bounds(length, len(books)), len(books[0])
    width = max(b - a for a, b in cuts)
    given = x.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(cuts), entries, width + 1), np.int64)
        for batch in batches:
            ints = vectors.matrix(batch.column(0), length)
            for p, (a, b) in enumerate(cuts):
                index, _ = nearest(ints[:, a:b], given.value[p])
                order = np.argsort(index, kind="stable")
                used, start = np.unique(index[order], return_index=True)
                if len(used):
                    total[p, used, : b - a] += np.add.reduceat(ints[order, a:b], start) if b > a else 0
                    total[p, used, width] += np.diff(np.r_[start, len(order)])
        flat = total.reshape(-1, width + 1)
        used = np.flatnonzero(flat[:, width])
        if len(used):
            yield vectors.rows_of(flat[used], used)

    parts = x.select("_x").mapInArrow(run, "key long, at long, s array<bigint>")
    found = vectors.collected(vectors.summed(parts, "decimal(38,0)"), len(cuts) * entries, width + 1, object)
    after = []
    for p, (a, b) in enumerate(cuts):
        book = books[p].copy()
        for k, row in enumerate(found[p * entries : (p + 1) * entries]):
            if row[width]:
                book[k] = [int(s) // int(row[width]) for s in row[: b - a]]
        after.append(book)
    return after


def fit(x: DataFrame, id: str, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one for each part position: the model that the driver holds, entries x length integers."""
    books = first_books(x, id, length, parts, entries)
    for _ in range(rounds if len(books[0]) else 0):
        books = renewed(x, length, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def encoded(x: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """packed() rows with code (two hex digits for each part) and error in place of ``_x``."""
    cuts, names = bounds(length, len(books)), [*x.columns[:-1], "code", "error"]
    given = x.sparkSession.sparkContext.broadcast(books)
    hexed = np.array([f"{k:02x}" for k in range(ENTRIES)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = vectors.matrix(batch.column(batch.num_columns - 1), length)
            code, error = np.full(len(ints), "", object), np.zeros(len(ints), np.int64)
            for p, (a, b) in enumerate(cuts):
                index, distance = nearest(ints[:, a:b], given.value[p])
                code, error = code + hexed[index], error + distance
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error)], names)

    return x.mapInArrow(run, x.drop("_x").schema.add("code", "string").add("error", "long"))


def compressed(table: DataFrame, id: str, keep: list[str], vector: str = "embedding") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, keep, code and error of each usable row, the codebooks).

    See vectors.usable() for rows that go. An empty table gives no rows and empty
    codebooks; of fewer than 256 vectors each is an entry; equal entries are told apart
    by the lower index, so that the higher stays unused. Repeated rows, also such of one
    id, are rows of their own.
    """
    columns = [*dict.fromkeys([id, *keep])]
    rows, length = vectors.usable(table, vector, columns)
    x = scratch.written(vectors.packed(rows, length), "integers")
    books = fit(x, id, length)
    return encoded(x, length, books), books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors, with the errors of their labels. Nulls, ties and empty tables are as compressed() says."""
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", ["label"])
    rows = scratch.written(rows, "codes")
    of_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = rows.alias("r").join(of_label.alias("l"), F.col("r.label").eqNullSafe(F.col("l.label")))
    return out.select("r.vec_id", "r.code", "r.error", "l.label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    kept = """kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding))"""
    parts = "parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, range(4) t(p))"
    first = "b0 AS MATERIALIZED (SELECT p, k - 1 AS k, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS k FROM kept) USING (r) WHERE k <= 256)"
    steps = [kept, parts, first]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(CAST(list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) * 256 + k) AS m FROM parts JOIN b{i} USING (p) GROUP BY r, p)")
        if i < ROUNDS:
            steps.append(f"""u{i} AS (SELECT p, k, list(CAST(floor_mean AS BIGINT) ORDER BY j) AS c FROM (
                SELECT p, k, j, (sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*) AS floor_mean
                FROM (SELECT p, m % 256 AS k, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS j FROM a{i}) GROUP BY p, k, j) GROUP BY p, k)""")
            steps.append(f"b{i + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(u.c, b.c) AS c FROM b{i} b LEFT JOIN u{i} u USING (p, k))")
    steps.append(f"codes AS (SELECT r, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)")
    steps.append(f"digest AS (SELECT sha256(string_agg(list_aggregate(c, 'string_agg', ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), digest"


QUERIES = {"op13_codes": op13_codes}
SQL = {"op13_codes": _sql()}
