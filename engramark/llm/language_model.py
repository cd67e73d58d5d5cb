"""Language-model scores by deleted interpolation.

The probability of a token mixes the maximum-likelihood estimates of its pair with
the token before, of the token alone, and of any token, by weights that depend on
how frequent the token before is. The weights are learned by expectation-
maximisation: counts of a part of the training documents predict the pairs of the
rest, which are held out from those counts. Every token and every pair of the
training documents is counted, however rare.

Tokens travel as hashes in compressed blobs: a batch of documents sends each of its
distinct tokens and pairs once, to the partition of its hash, so that a frequent one
burdens none; there the counts of all batches meet, and the sums go back to the batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import bytetext, scratch

FOLDS, HELD_OUT, DEVELOPMENT = 7, 2, 6
#: Contexts are mixed alike if their counts have the same number of binary digits.
BUCKETS = 48
#: Bytes of text in a batch, and for each partition in which counts meet.
BATCH = 16 << 20
PART_BYTES = 16 << 20
#: The token that ends a text, and stands before its first word.
END = np.uint64(0x0123456789ABCDEF)
#: Steps per doubling and number of steps in which estimates are counted for the weights.
STEPS, WIDTH = 4, 512
_TOKEN_BITS = np.uint64((1 << 56) - 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, their bytes sorted by significance."""
    planes = [(a.dtype.str, len(a), np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"") for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def unpacked(blob: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return [np.frombuffer(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, n).T).tobytes(), kind) if n else np.zeros(0, kind) for kind, n, raw in planes]


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, fold (-1 where doc_id is null: it neither trains nor is held out) and text."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(-1)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col("text").cast("string").alias("text"))


def token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, folds, tokens, pointer) of about BATCH bytes of texts; each text's tokens are its words and END."""
    ids, folds, tokens, sizes, held = [], [], [], [], 0
    for rows, data, offs in bytetext.pieces(batches):
        hashes, _, _, pointer = bytetext.words(data, offs)
        with_end = np.insert(hashes & _TOKEN_BITS, pointer[1:], END & _TOKEN_BITS)
        ids += rows.column(0).to_pylist()
        folds.append(rows.column(1).to_numpy()), tokens.append(with_end), sizes.append(np.diff(pointer) + 1)
        held += len(data)
        if held >= BATCH:
            yield ids, np.concatenate(folds), np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            ids, folds, tokens, sizes, held = [], [], [], [], 0
    if ids:
        yield ids, np.concatenate(folds), np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def bucket(count: np.ndarray) -> np.ndarray:
    """The bucket of a context with this count: 0 for a context without one, which has no pairs."""
    return np.clip(np.frexp(count.astype(np.float64))[1], 0, BUCKETS - 1)


def cell(context: np.ndarray, n2: np.ndarray, n12: np.ndarray) -> np.ndarray:
    """Cells of bucket, token count and pair probability from the counts of a context, a token and their pair; step 0 stands for none."""
    one = np.where(n2 > 0, 1 + np.rint(STEPS * np.log2(np.maximum(1, n2))), 0)
    two = np.where(n12 > 0, 1 + np.rint(STEPS * np.log2(np.maximum(1, context) / np.maximum(1, n12))), 0)
    one, two = (np.clip(x, 0, WIDTH - 1).astype(np.int64) for x in (one, two))
    return (bucket(context) * WIDTH + one) * WIDTH + two


def learned(cells: np.ndarray, weights: np.ndarray, fit: int, distinct: int, rounds: int = 100) -> np.ndarray:
    """Weights (any token, token, pair) for each bucket, by expectation-maximisation over the counted cells.

    ``fit`` and ``distinct`` are the tokens counted for the estimates and the vocabulary. A
    bucket without held-out pairs has the weights of the next rarer one.
    """
    step = np.arange(WIDTH) - 1
    single = np.where(step >= 0, 2.0 ** (step / STEPS) / max(1, fit) * (distinct + 1), 0)
    paired = np.where(step >= 0, 2.0 ** (-step / STEPS) * (distinct + 1), 0)
    of = cells // WIDTH // WIDTH
    estimates = np.stack([np.ones(len(cells)), single[cells // WIDTH % WIDTH], paired[cells % WIDTH]], 1)
    mixture = np.tile([0.1, 0.5, 0.4], (BUCKETS, 1))
    mixture[0] = [0.1, 0.9, 0]
    for b in range(BUCKETS):
        x, w, lam = estimates[of == b], weights[of == b], mixture[b]
        if not len(x):
            mixture[b] = mixture[b - 1] if b > 1 else lam
            continue
        for _ in range(rounds):
            parts = x * lam
            lam = (parts / parts.sum(1, keepdims=True) * w[:, None]).sum(0) / w.sum()
            lam = np.maximum(lam, [1e-6, 1e-6, 1e-6 if b else 0])
            lam = lam / lam.sum()
        mixture[b] = lam
    return mixture


ROWS = "src long, dst int, kind int, n long, data binary"
#: What a row holds: a batch's documents, counts of one partition for a batch, counted cells (n is the weight, src the cell),
#: the totals of one partition, or a batch with all its counts.
DOCUMENTS, COUNTS, CELLS, TOTALS, COUNTED = range(5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([],) * 5
    types = pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["src", "dst", "kind", "n", "data"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each 56-bit hash; ascending hashes have ascending partitions."""
    return ((keys >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def contexts(at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """For tokens of texts that each end with END: the token before, END for the first."""
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[pointer[:-1]] = at[pointer[1:] - 1]
    return before


def pair_keys(name: np.ndarray, at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """A 56-bit hash of each token with the token before; ``at`` are places in ``name``."""
    with np.errstate(over="ignore"):
        return bytetext.mix(name[at] * np.uint64(0x9E3779B97F4A7C15) + bytetext.mix(name)[contexts(at, pointer)]) >> np.uint64(8)


def requests(docs: DataFrame, parts: int) -> DataFrame:
    """For each batch: its documents as places in its list of tokens, and for each partition the hashes of distinct tokens and pairs dealt to it, with their training and development counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        src = TaskContext.get().partitionId() << 24
        with np.errstate(over="ignore"):
            for ids, folds, tokens, pointer in token_batches(batches):
                fold = np.repeat(folds, np.diff(pointer))
                trains, develops = (fold >= 0) & (fold != HELD_OUT), fold == DEVELOPMENT
                name, at = np.unique(tokens, return_inverse=True)
                key, rank = np.unique(pair_keys(name, at, pointer), return_inverse=True)
                asked = [(x, dealt(x, parts), *(np.bincount(which, on, len(x)).astype(np.int32) for on in (trains, develops))) for x, which in ((name, at), (key, rank))]
                # Frequent tokens come first in the batch's list: small numbers pack well.
                order = np.argsort(-np.bincount(at), kind="stable")
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order))
                rows = [(src, (src >> 24) % parts, DOCUMENTS, len(ids), pickle.dumps((ids, folds, pointer, packed(name[order]), packed(place[at]))))]
                cuts = [np.searchsorted(to, np.arange(parts + 1)) for _, to, *_ in asked]
                for part in np.union1d(asked[0][1], asked[1][1]).tolist():
                    blobs = [packed(np.diff(x[c[part] : c[part + 1]], prepend=np.uint64(0)), *(n[c[part] : c[part + 1]] for n in counts)) for (x, _, *counts), c in zip(asked, cuts, strict=True)]
                    rows.append((src, part, COUNTS, len(ids), pickle.dumps(blobs)))
                yield _rows(rows)
                src += 1

    return docs.mapInArrow(run, ROWS)


def _met(asked: list[list[np.ndarray]]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """For each (keys, n, dev): the corpus sums of n and of n - dev for its keys, packed; and both sums of every distinct key."""
    keys, n, dev = (np.concatenate([a[k] for a in asked]) for k in range(3))
    if not len(keys):
        return [packed(*(np.zeros(0, np.int64),) * 2) for _ in asked], np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    sums = [np.add.reduceat(x[order].astype(np.int64), first) for x in (n, n - dev)]
    which = np.empty(len(keys), np.int64)
    which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    ends = np.cumsum([len(a[0]) for a in asked])
    return [packed(*(x[which[e - len(a[0]) : e]] for x in sums)) for a, e in zip(asked, ends, strict=True)], *sums


def counts_met(rows: DataFrame, parts: int) -> DataFrame:
    """The requests with the corpus counts of their tokens and pairs in place of the hashes, and the totals of each partition."""

    def meet(dst: int, src: list, sizes: list, blobs: list) -> list[tuple]:
        single, paired = ([(np.cumsum(keys, dtype=np.uint64), n, dev) for keys, n, dev in map(unpacked, x)] for x in zip(*map(pickle.loads, blobs), strict=True))
        single, n, fit = _met(single)
        paired, _, _ = _met(paired)
        totals = pickle.dumps((int(n.sum()), int(fit.sum()), int((n > 0).sum())))
        return [(-1 - dst, dst, TOTALS, 0, totals), *((s, dst, COUNTS, size, pickle.dumps(x)) for s, size, *x in zip(src, sizes, single, paired, strict=True))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for src, dst, kind, n, data in _read(batches):
            if kind == DOCUMENTS:
                yield _rows([(src, dst, kind, n, data)])
                continue
            if dst != now and held[0]:
                yield _rows(meet(now, *held))
                held = ([], [], [])
            now = dst
            for column, value in zip(held, (src, n, data), strict=True):
                column.append(value)
        if held[0]:
            yield _rows(meet(now, *held))

    return rows.repartitionById(parts, "dst").sortWithinPartitions("dst", "src").mapInArrow(run, ROWS)


def batches_counted(met: DataFrame, parts: int) -> DataFrame:
    """Each batch as one row with all its counts, the cells of its development pairs, and the totals."""

    def together(src: int, size: int, about: bytes, answers: list[bytes]) -> list[tuple]:
        (n, fit), (n12, fit12) = ((np.concatenate(x) for x in zip(*map(unpacked, blobs), strict=True)) for blobs in zip(*map(pickle.loads, answers), strict=True))
        ids, folds, pointer, name, at = pickle.loads(about)
        (name,), (at,) = unpacked(name), unpacked(at)
        _, rank = np.unique(pair_keys(name, at, pointer), return_inverse=True)
        # The answers are in the order of hashes.
        place = np.argsort(np.argsort(name))
        n, fit, n12, fit12 = n[place], fit[place], n12[rank], fit12[rank]
        held = np.flatnonzero(np.repeat(folds, np.diff(pointer)) == DEVELOPMENT)
        found, times = np.unique(cell(fit[contexts(at, pointer)[held]], fit[at[held]], fit12[held]), return_counts=True)
        out = [(int(c), 0, CELLS, int(w), None) for c, w in zip(found, times, strict=True)]
        return [*out, (src, 0, COUNTED, size, pickle.dumps((ids, folds, pointer, packed(n), packed(at), packed(n12))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, about, answers = None, 0, None, []
        for src, dst, kind, n, data in _read(batches):
            if kind == TOTALS:
                yield _rows([(src, dst, kind, n, data)])
                continue
            if src != now and answers:
                yield _rows(together(now, size, about, answers))
                answers = []
            now, size = src, n
            if kind == DOCUMENTS:
                about = data
            else:
                answers.append(data)
        if answers:
            yield _rows(together(now, size, about, answers))

    home = F.expr(f"cast(pmod((src >> 24) + (src & 16777215) * 7919, {parts}) as int)")
    return met.repartitionById(parts, home).sortWithinPartitions("src", "kind", "dst").mapInArrow(run, ROWS)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row.

    A null or empty text is one token, the end. A null doc_id neither trains nor is
    held out. Repeated rows count each. Without training documents every token is
    unknown. An empty table gives no rows; columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    # A task's memory is that of the tokens dealt to one partition, so their number grows with the texts.
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    parts = max(scratch.shuffle_partitions(spark), -(-size // PART_BYTES))
    counted = scratch.written(batches_counted(counts_met(requests(folded(docs), parts), parts), parts), "counted-batches")
    # One row of three numbers for each partition, and one for each cell: neither grows with the documents.
    totals = [pickle.loads(r["data"]) for r in counted.where(F.col("kind") == TOTALS).select("data").collect()]
    total, fit, distinct = (sum(x) for x in zip(*totals, strict=True)) if totals else (0, 0, 0)
    cells = counted.where(F.col("kind") == CELLS).groupBy("src").agg(F.sum("n").alias("n")).collect()
    mixture = learned(np.array([r["src"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.float64), fit, distinct)
    if not total:
        mixture = np.tile([1.0, 0, 0], (BUCKETS, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.log10(total + distinct + 1)
        for _, _, _, size, data in _read(batches):
            ids, folds, pointer, *blobs = pickle.loads(data)
            n, at, n12 = (x for blob in blobs for x in unpacked(blob))
            n1, n2 = n[contexts(at, pointer)], n[at]
            weight = mixture[bucket(n1)]
            p = weight[:, 0] / (distinct + 1) + weight[:, 1] * n2 / max(1, total) + weight[:, 2] * n12 / np.maximum(1, n1)
            sums = [np.add.reduceat(x, pointer[:-1]) for x in ((n2 > 0).astype(np.int64), np.log10(n2 + 1) - base, np.log10(p))]
            columns = [pa.array(ids, pa.int64()), pa.array(folds == HELD_OUT), pa.array(np.diff(pointer).astype(np.int64)), pa.array(sums[0]), pa.array([total] * size, pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    whole = counted.where(F.col("kind") == COUNTED)
    return whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_language_model": op5_language_model}
SQL: dict[str, str] = {}
