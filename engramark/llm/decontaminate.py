"""Benchmark decontamination with an FM-index for each shard of the training documents.

Words are ASCII digits, lower-cased letters and everything beyond ASCII. A phrase
is a window of ten words of a benchmark item, or a whole shorter item. All words of
a shard become symbols, and document ends separate. Phrases are searched backwards
through wavelet-tree ranks, located by sampled suffix positions, and their spans
merged. The benchmark is searched for block by block, in a pass over the documents
each: neither a task nor the driver holds more than one.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import bytetext, scratch
from engramark.llm.fm_index import FMIndex

WINDOW = 10
#: Bytes of documents in a shard, and of benchmark texts in a block.
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20


class Shard:
    """The index of all words of a shard's documents; words of document d are pointer[d] to pointer[d + 1]."""

    def __init__(self, hashes: np.ndarray, pointer: np.ndarray) -> None:
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        # A separator follows each document.
        text = np.insert(symbol.astype(np.int64) + 1, pointer[1:], 0)
        self.starts, self.ends = pointer[:-1], np.arange(len(pointer) - 1) + pointer[1:]
        self.index = FMIndex(text, len(self.vocabulary))

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the shard, 0 for others."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence in the shard."""
        matrix = self.symbols(phrases.matrix.reshape(-1)).reshape(phrases.matrix.shape)
        inside = np.arange(matrix.shape[1]) >= matrix.shape[1] - phrases.lengths[:, None]
        known = np.flatnonzero(((matrix > 0) | ~inside).all(1))
        low, high = self.index.ranges(matrix[known], phrases.lengths[known])
        times = high - low
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        place = self.index.locate(rows)
        # Positions count the separators before them.
        return place - np.searchsorted(self.ends, place), np.repeat(known, times)


class Phrases:
    """The distinct phrases of a block of benchmark items, as hashes of words, right-aligned in a matrix."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        raws = [t.encode() for _, t in items]
        data = np.frombuffer(b"".join(raws), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
        hashes, _, _, pointer = bytetext.words(data, offs, bytetext.ALNUM)
        self.names = [name for name, _ in items]
        of_item: dict[bytes, set[int]] = {}
        for k, (a, b) in enumerate(zip(pointer[:-1], pointer[1:], strict=True)):
            for s in range(a, max(a, b - window) + 1) if b > a else ():
                of_item.setdefault(hashes[s : min(b, s + window)].tobytes(), set()).add(k)
        self.lengths = np.array([len(p) // 8 for p in of_item], np.int64)
        self.matrix = np.zeros((len(of_item), window), np.uint64)
        for row, phrase in zip(self.matrix, of_item, strict=True):
            row[window - len(phrase) // 8 :] = np.frombuffer(phrase, np.uint64)
        self.item_pointer = np.concatenate([[0], np.cumsum([len(x) for x in of_item.values()])]).astype(np.int64)
        self.items = np.array([k for x in of_item.values() for k in sorted(x)], np.int64)


def benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items with an id and a text, in blocks of about BLOCK_BYTES."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((r["i"], r["t"]))
        size += len(r["t"].encode())
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS = "array<struct<first: long, end: long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans and items for every row of ``docs``.

    spans are the merged runs [first, end) of words inside an occurrence of a
    phrase; items the ids, as sorted strings, of the items with one. A null or
    wordless text has neither; items without words, text or id are never found;
    items with the same id count once. Repeated rows give repeated results, an
    empty table none; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = benchmark_blocks(benchmark)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return searched(texts, first, window).drop("key")
    # Each pass is written before the next block is read; rows equal in both columns have equal results.
    found = [scratch.written(searched(texts, b, window).dropDuplicates(["doc_id", "key"]), "contamination") for b in itertools.chain([first, second], blocks)]
    every = functools.reduce(DataFrame.union, found)
    together = every.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(x) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, batch.column(3).type), batch.column(4)], batch.schema.names)

    together = together.mapInArrow(run, together.schema)
    mine = texts.select("doc_id", F.xxhash64("text").alias("key")).alias("a")
    return mine.join(together.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))).select("a.doc_id", "n_words", "spans", "items")


def merged(spans: list[dict]) -> list[dict]:
    """Sorted spans with those that overlap or touch made one."""
    out: list[dict] = []
    for s in spans:
        if out and s["first"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def searched(texts: DataFrame, block: list[tuple[str, str]], window: int) -> DataFrame:
    """doc_id, key (the text's hash), n_words, spans and items of one block of the benchmark."""
    given = texts.sparkSession.sparkContext.broadcast(block)

    def judge(doc_ids: list, keys: list, hashes: np.ndarray, pointer: np.ndarray, phrases: Phrases) -> pa.RecordBatch:
        cover = np.zeros(len(hashes) + 1, np.int64)
        items: list[set[str]] = [set() for _ in doc_ids]
        first, phrase = Shard(hashes, pointer).find(phrases) if len(phrases.lengths) else (np.zeros(0, np.int64),) * 2
        np.add.at(cover, first, 1)
        np.add.at(cover, first + phrases.lengths[phrase], -1)
        doc = np.searchsorted(pointer, first, "right") - 1
        for d, q in np.unique(np.stack([doc, phrase]), axis=1).T:
            items[d].update(phrases.names[k] for k in phrases.items[phrases.item_pointer[q] : phrases.item_pointer[q + 1]])
        hit = np.cumsum(cover[:-1]) > 0
        cut = np.zeros(len(hit) + 1, bool)
        cut[pointer] = True
        starts = np.flatnonzero(hit & (cut[:-1] | ~np.concatenate([[False], hit[:-1]])))
        ends = np.flatnonzero(hit & (cut[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
        spans = np.searchsorted(starts, pointer)
        base = np.repeat(pointer[:-1], np.diff(spans))
        pairs = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base)], ["first", "end"])
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(np.diff(pointer)), bytetext.list_column(pairs, spans), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "key", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(given.value, window)
        ids, keys, hashes, pointers, words, size = [], [], [], [np.zeros(1, np.int64)], 0, 0
        for rows, data, offs in bytetext.pieces(batches):
            found, _, _, pointer = bytetext.words(data, offs, bytetext.ALNUM)
            ids += rows.column(0).to_pylist()
            keys += rows.column(1).to_pylist()
            hashes.append(found), pointers.append(pointer[1:] + words)
            words, size = words + len(found), size + len(data)
            if size >= SHARD_BYTES:
                yield judge(ids, keys, np.concatenate(hashes), np.concatenate(pointers), phrases)
                ids, keys, hashes, pointers, words, size = [], [], [], [np.zeros(1, np.int64)], 0, 0
        if ids:
            yield judge(ids, keys, np.concatenate(hashes), np.concatenate(pointers), phrases)

    return texts.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id long, key long, n_words long, spans {SPANS}, items array<string>")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


QUERIES = {"op8_decontaminate": op8_decontaminate}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op8_decontaminate": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT item_id, least(len(ws), 10) AS size, array_to_string(ws[i:i + 9], ' ') AS g
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM p),
o AS (
  SELECT doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') AS g
  FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
m AS (SELECT o.doc_id, o.i, o.size, p.item_id FROM o JOIN p ON p.g = o.g AND p.size = o.size),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
