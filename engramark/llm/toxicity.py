"""Toxic spans by a linear-chain conditional random field over two tags.

Tokens of labelled documents are tagged from their document's label: one is toxic if
its document is and one of its marks (the word, or how it begins) is found almost only in toxic ones.
The field learns tags from the marks of a token and its neighbours and from the tag
before; forward-backward gives every token's marginal. A document's score is a
logistic function of its marginals, calibrated on labelled documents that the field hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramark.llm import bytetext, scratch, vectors

#: Bounds of the fit: documents of each label, and bytes of a text.
FIT_DOCS = {1: 2000, 0: 4000}
FIT_BYTES = 32768
#: One labelled document in so many calibrates the score; the others train the field.
CALIBRATE = 4
#: Bytes of a word's beginnings that are marks beside the word itself.
BEGINNINGS = (4, 5, 6, 8)
#: Marks that the field knows at most, how many documents have one at least, and the G statistic from which one counts.
MARKS = 20_000
LEAST_DOCS = 3
LEAST_G = 6.6
#: A mark tags a token: its G statistic, and how many times likelier it is in toxic documents.
TAGS_G = 18.0
TAGS_RATIO = 8.0
#: Weight of the squared parameters in the loss, and rounds of the minimisation.
RIDGE = 0.5
ROUNDS = 30
#: Emissions are cut off here, so that no product of a chain underflows.
STEEP = 30.0
#: A token is in a span from this marginal on; smaller marginals than FAINT don't count for a document.
SPAN = 0.5
FAINT = 0.1
#: A document is toxic from this score on.
THRESHOLD = 0.7
#: Hash functions whose least shingles tell near copies in the fit's sample.
MINIMA = 3
SECTION = 2 << 20
BLOCK = 256


@dataclass
class Field:
    """marks: sorted hashes; tagging: which of them tag; weights: of the marks of the token before, the token and the one after;
    bias of toxic; step[i, j] and start[j]: of tag j after tag i and at the start; score: weights of a document's measures."""

    marks: np.ndarray
    tagging: np.ndarray
    weights: np.ndarray
    bias: float
    step: np.ndarray
    start: np.ndarray
    score: np.ndarray


def marked_words(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(mark hashes, first byte, end, text) of the words (ASCII letters and digits, all beyond ASCII) of sections of texts; 0 is no mark."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SECTION)
        while end < len(data):
            # No word is cut: on to the next byte that is in none.
            stop = np.flatnonzero(~bytetext.ALNUM[bytetext.LOWER[data[end : end + SECTION]]])
            if len(stop):
                end += int(stop[0])
                break
            end = min(len(data), end + SECTION)
        inner = np.unique(np.clip(offs, at, end))
        word, first, last, _ = bytetext.words(data[at:end], np.unique(np.r_[at, inner, end]) - at, bytetext.ALNUM)
        low = bytetext.LOWER[data[at:end]]
        marks = np.zeros((len(word), 1 + len(BEGINNINGS)), np.uint64)
        marks[:, 0] = word
        for k, size in enumerate(BEGINNINGS, 1):
            long = np.flatnonzero(last - first >= size)
            marks[long, k] = bytetext.mix(bytetext.span_hashes(low, first[long], first[long] + size) + np.uint64(k))
        yield marks, first + at, last + at, np.searchsorted(offs, first + at, "right") - 1
        at = end


def places(marks: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Where each mark stands in the sorted ``known``, or -1."""
    out = np.full(marks.shape, -1, np.int32)
    maybe = np.nonzero(sieve[(marks >> np.uint64(44)).astype(np.int64)])
    if len(known) and len(maybe[0]):
        h = marks[maybe]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out[maybe] = np.where(known[at] == h, at, -1)
    return out


def sieve_of(known: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 20, bool)
    sieve[(known >> np.uint64(44)).astype(np.int64)] = True
    return sieve


def tokens(data: np.ndarray, offs: np.ndarray, known: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of marks, first byte, end, pointer): the tokens of text i are pointer[i] to pointer[i + 1]."""
    found = [(places(marks, known, sieve), first, last, text) for marks, first, last, text in marked_words(data, offs)]
    if not found:
        return np.zeros((0, 1 + len(BEGINNINGS)), np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    at, first, last, text = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, first, last, np.searchsorted(text, np.arange(len(offs)))


def firsts(n: int, pointer: np.ndarray) -> np.ndarray:
    """Which of n tokens begin a text."""
    out = np.zeros(n, bool)
    out[pointer[:-1][np.diff(pointer) > 0]] = True
    return out


def emissions(at: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """How much likelier toxic is than clean for each token, from its marks and its neighbours'."""
    n = len(at)
    sums = np.zeros((3, n))
    row, kind = np.nonzero(at >= 0)
    for k in range(3):
        sums[k] = np.bincount(row, field.weights[k][at[row, kind]], n)
    e = field.bias + sums[1]
    if n:
        e[1:] += np.where(first[1:], 0, sums[0][:-1])
        e[:-1] += np.where(first[1:], 0, sums[2][1:])
    return np.clip(e, -STEEP, STEEP)


def chained(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(v, norm): v[:, t] = v[:, t - 1] m[:, :, t], scaled to a sum of 1, and by how much; v before the first is even.

    Blocks of successive matrices are multiplied side by side, then the vector goes
    from block to block, then through all blocks side by side.
    """
    n = m.shape[2]
    blocks = -(-n // BLOCK)
    full = np.zeros((2, 2, blocks * BLOCK))
    full[0, 0] = full[1, 1] = 1.0
    full[:, :, :n] = m
    a, b, c, d = (np.ascontiguousarray(full[i, j].reshape(blocks, BLOCK).T) for i in (0, 1) for j in (0, 1))
    p, q, r, s = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for k in range(BLOCK):
        p, q, r, s = p * a[k] + q * c[k], p * b[k] + q * d[k], r * a[k] + s * c[k], r * b[k] + s * d[k]
        if k % 8 == 7:
            size = p + q + r + s
            p, q, r, s = p / size, q / size, r / size, s / size
    start, x, y = np.empty((2, blocks)), 0.5, 0.5
    for k, (pk, qk, rk, sk) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        start[0, k], start[1, k] = x, y
        x, y = x * pk + y * rk, x * qk + y * sk
        x, y = x / (x + y), y / (x + y)
    v, norm, (x, y) = np.empty((2, BLOCK, blocks)), np.empty((BLOCK, blocks)), start
    for k in range(BLOCK):
        x, y = x * a[k] + y * c[k], x * b[k] + y * d[k]
        norm[k] = x + y
        x, y = x / norm[k], y / norm[k]
        v[0, k], v[1, k] = x, y
    return v.transpose(0, 2, 1).reshape(2, -1)[:, :n], norm.T.ravel()[:n]


def matrices(e: np.ndarray, first: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(m, scale): exp(scale) m[i, j, t] is the weight of tag j of token t after tag i; a text's first token has no tag before it."""
    scale = np.maximum(e, 0)
    m = np.exp(field.step)[:, :, None] * np.exp(np.stack([-scale, e - scale]))[None]
    m[:, :, first] = np.exp(field.start)[None, :, None] * np.exp(np.stack([-scale, e - scale]))[None, :, first]
    return m, scale


def forward_backward(m: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, norm): scaled so that forward * backward, over its sum, are a token's marginals."""
    n = m.shape[2]
    forward, norm = chained(m)
    back = np.ones((2, 2, n))
    if n > 1:
        on = np.flatnonzero(~first[1:])
        back[:, :, on] = m[:, :, on + 1].transpose(1, 0, 2)
    backward, _ = chained(back[:, :, ::-1])
    return forward, backward[:, ::-1], norm


def marginals(e: np.ndarray, first: np.ndarray, field: Field) -> np.ndarray:
    """Each token's probability of being toxic."""
    if not len(e):
        return np.zeros(0)
    forward, backward, _ = forward_backward(matrices(e, first, field)[0], first)
    both = forward * backward
    return both[1] / both.sum(0)


def loss_and_slope(at: np.ndarray, first: np.ndarray, tags: np.ndarray, field: Field) -> np.ndarray:
    """The negative log-likelihood of the tags, then its derivatives by bias, step, start and weights, in one array."""
    e = emissions(at, first, field)
    m, scale = matrices(e, first, field)
    forward, backward, norm = forward_backward(m, first)
    both = forward * backward
    p = both[1] / both.sum(0)
    on = np.flatnonzero(~first)
    said = float(e @ tags) + field.start[tags[first]].sum() + field.step[tags[on - 1], tags[on]].sum()
    z = np.log(norm).sum() + scale.sum()
    pair = forward[:, None, on - 1] * m[:, :, on] * backward[None, :, on]
    pair = (pair / pair.sum((0, 1))).sum(2)
    np.subtract.at(pair, (tags[on - 1], tags[on]), 1.0)
    off = p - tags
    start = np.array([-off[first].sum(), off[first].sum()])
    slope = np.zeros_like(field.weights)
    row, kind = np.nonzero(at >= 0)
    where = at[row, kind]
    after, before = np.zeros(len(e)), np.zeros(len(e))
    after[:-1] = np.where(first[1:], 0, off[1:])
    before[1:] = np.where(first[1:], 0, off[:-1])
    for k, by in enumerate((after, off, before)):
        slope[k] = np.bincount(where, by[row], slope.shape[1])
    return np.concatenate([[z - said, off.sum()], pair.ravel(), start, slope.ravel()])


def _vector(field: Field) -> np.ndarray:
    return np.concatenate([[field.bias], field.step.ravel(), field.start, field.weights.ravel()])


def _with_vector(field: Field, v: np.ndarray) -> Field:
    return Field(field.marks, field.tagging, v[7:].reshape(3, -1), float(v[0]), v[1:5].reshape(2, 2), v[5:7], field.score)


def minimised(f, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """x after ``rounds`` of limited-memory quasi-Newton steps on f, which gives (value, slope); a step that doesn't lower f is halved."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, used = slope.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(steps, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        length = 1.0
        while True:
            after = x - length * q
            now, turned = f(after)
            if now <= value - 1e-4 * length * (slope @ q) or length < 1e-3:
                break
            length /= 2
        if now >= value or value - now < 1e-5 * abs(value):
            return after if now < value else x
        if (after - x) @ (turned - slope) > 1e-12:
            steps = [*steps[1 - memory :], (after - x, turned - slope)]
        x, value, slope = after, now, turned
    return x


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) that the fit may see: of each label the documents with the smallest hashes, near copies of one another once.

    Labels are 1 where any row of a doc_id says so. Documents without an id, a label or
    a word, and those of more than FIT_BYTES, teach nothing; of several texts of one
    doc_id the smallest does.
    """
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id")
    few = [marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(n) for label, n in FIT_DOCS.items()]
    ids = scratch.written(few[0].union(few[1]), "labelled")
    short = docs.where((F.octet_length("text") <= FIT_BYTES)).select("doc_id", "text")
    rows = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in bytetext.pieces(batches):
            word, _, _, pointer = bytetext.words(data, offs, bytetext.ALNUM)
            least = np.zeros((MINIMA, part.num_rows), np.int64)
            for i in range(part.num_rows):
                h = word[pointer[i] : pointer[i + 1]]
                shingles = bytetext.mix(h[:-2] * np.uint64(3) + bytetext.mix(h[1:-1] * np.uint64(5) + h[2:])) if len(h) > 2 else h
                for k in range(MINIMA if len(h) else 0):
                    least[k, i] = bytetext.mix(shingles ^ np.uint64(0x9E37 * (k + 1))).min().view(np.int64)
            keep = np.diff(pointer) > 0
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, least)], [*part.schema.names, *(f"m{k}" for k in range(MINIMA))]).filter(pa.array(keep))

    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType()), *(T.StructField(f"m{k}", T.LongType()) for k in range(MINIMA))])
    once = rows.mapInArrow(run, kind)
    for k in range(MINIMA):
        once = once.withColumn("_k", F.row_number().over(Window.partitionBy(f"m{k}").orderBy("doc_id"))).where("_k = 1").drop("_k")
    return scratch.written(once.select("doc_id", "toxic", "text"), "sample")


def known_marks(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(marks, tagging): the sorted hashes of marks that are commoner in toxic documents than in clean ones, and which of them tag a token."""
    total = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return np.zeros(0, np.uint64), np.zeros(0, bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in bytetext.pieces(batches):
            toxic = part.column(0).to_numpy()
            for label in (0, 1):
                have = []
                for marks, _, _, text in marked_words(data, offs):
                    row, kind = np.nonzero((marks != 0) & (toxic[text] == label)[:, None])
                    have.append(np.unique(np.stack([marks[row, kind], text[row].astype(np.uint64)]), axis=1))
                marks, n = np.unique(np.unique(np.concatenate(have, axis=1), axis=1)[0], return_counts=True) if have else (np.zeros(0, np.uint64),) * 2
                yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64)), pa.array(np.full(len(marks), label, np.int32)), pa.array(n.astype(np.int64))], ["mark", "toxic", "n"])

    counts = rows.select("toxic", "text").mapInArrow(run, "mark long, toxic int, n long").groupBy("mark").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).cast("double").alias(f"n{k}") for k in (0, 1)))
    n = float(total[0] + total[1])

    def term(have: Column, of: float) -> Column:
        return F.when(have > 0, have * F.log(have * n / (of * (F.col("n0") + F.col("n1"))))).otherwise(0.0)

    def lacks(have: Column, of: float) -> Column:
        left = F.lit(of) - have
        return F.when(left > 0, left * F.log(left * n / (of * (n - F.col("n0") - F.col("n1"))))).otherwise(0.0)

    g = 2 * (term(F.col("n1"), total[1]) + term(F.col("n0"), total[0]) + lacks(F.col("n1"), total[1]) + lacks(F.col("n0"), total[0]))
    ratio = (F.col("n1") / total[1]) / ((F.col("n0") + 0.5) / (total[0] + 1.0))
    likely = counts.where((F.col("n0") + F.col("n1") >= LEAST_DOCS) & (F.col("n1") * total[0] > F.col("n0") * total[1])).withColumn("g", g).withColumn("ratio", ratio)
    found = likely.where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "mark").limit(MARKS).collect()
    marks = np.array([r["mark"] for r in found], np.int64).view(np.uint64)
    tags = np.array([r["g"] >= TAGS_G and r["ratio"] >= TAGS_RATIO for r in found], bool)
    order = np.argsort(marks)
    return marks[order], tags[order]


def tagged(rows: DataFrame, marks: np.ndarray, tagging: np.ndarray) -> DataFrame:
    """Labelled tokens of (toxic, text) rows: blocks of whole texts, with the places of marks, the texts' first tokens, and tags."""
    given = rows.sparkSession.sparkContext.broadcast((marks, tagging, sieve_of(marks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tags, sieve = given.value
        for part, data, offs in bytetext.pieces(batches):
            at, _, _, pointer = tokens(data, offs, known, sieve)
            toxic = np.repeat(part.column(0).to_numpy(), np.diff(pointer)) == 1
            tag = ((at >= 0) & np.r_[tags, False][at]).any(1) & toxic
            cells = (at.astype("<i4").tobytes(), firsts(len(at), pointer).tobytes(), tag.astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["at", "first", "tag"])

    return scratch.written(rows.select("toxic", "text").mapInArrow(run, "at binary, first binary, tag binary"), "tagged")


def trained(blocks: DataFrame, field: Field, rounds: int = ROUNDS) -> Field:
    """The field that best explains the labelled tokens of tagged(): each evaluation of loss and slope is one pass, added up by Spark."""
    spark = blocks.sparkSession

    def run_with(given):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for at, first, tag in zip(*batch.columns, strict=True):
                    first = np.frombuffer(first.as_py(), bool)
                    if len(first):
                        found = loss_and_slope(np.frombuffer(at.as_py(), "<i4").reshape(len(first), -1), first, np.frombuffer(tag.as_py(), np.int8).astype(int), given.value)
                        total = found if total is None else total + found
            if total is not None:
                yield vectors.rows_of(total[None, :], np.zeros(1, np.int64))

        return run

    def f(v: np.ndarray) -> tuple[float, np.ndarray]:
        given = spark.sparkContext.broadcast(_with_vector(field, v))
        sums = vectors.summed(blocks.mapInArrow(run_with(given), "key long, at long, s array<double>"), "double")
        found = vectors.collected(sums, 1, len(v) + 1, float)[0]
        given.unpersist()
        return found[0] + RIDGE * (v @ v), found[1:] + 2 * RIDGE * v

    return _with_vector(field, minimised(f, _vector(field), rounds))


def measures(p: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """What a text's score is made of, a row for each: 1, its largest marginal, and the sum of those that aren't faint, as it is and for 100 tokens, both as logarithms."""
    n = np.diff(pointer)
    out = np.zeros((len(n), 4))
    out[:, 0] = 1
    some = np.flatnonzero(n)
    if len(some):
        sums = np.add.reduceat(np.where(p >= FAINT, p, 0), pointer[some])
        out[some, 1:] = np.stack([np.maximum.reduceat(p, pointer[some]), np.log1p(sums), np.log1p(100 * sums / n[some])], axis=1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic function of measures for labels y, by Newton steps; the ridge spares the first weight. Weights of measures are never negative."""
    free = np.ones(x.shape[1], bool)
    while True:
        w, pull = np.zeros(x.shape[1]), np.r_[1e-6, np.full(x.shape[1] - 1, ridge)]
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -STEEP, STEEP)))
            slope = x.T @ (p - y) + pull * w
            curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull + 1e-9)
            step = np.zeros_like(w)
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            w = w - np.clip(step, -2, 2)
        below = free & (w < 0)
        below[0] = False
        if not below.any():
            return w
        free &= ~below


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """A field for the labels (doc_id, toxic) of docs (doc_id, text). With labels of one kind only, or none, all scores are that label, or a half."""
    rows = sample(docs, labels)
    kinds = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    base = np.array([(-20.0, 20.0)[max(kinds)] if kinds else 0.0, 0.0, 0.0, 0.0])
    blank = Field(np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros((3, 0)), -5.0, np.zeros((2, 2)), np.zeros(2), base)
    if len(kinds) < 2:
        return blank
    fold = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fold")), F.lit(CALIBRATE))
    train = rows.where(fold != 0)
    marks, tagging = known_marks(train)
    field = Field(marks, tagging, np.zeros((3, len(marks))), -5.0, np.zeros((2, 2)), np.zeros(2), base)
    if len(marks):
        field = trained(tagged(train, marks, tagging), field)
    seen = measured(rows.where(fold == 0).select("toxic", "text"), field, ["toxic"]).select("toxic", "_measures").collect()
    if {r["toxic"] for r in seen} == {0, 1}:
        field.score = logistic(np.array([r["_measures"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    else:
        field.score = np.array([np.log(kinds[1] / kinds[0]), 4.0, 1.0, 0.0])
    return field


def measured(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, _measures, n_tokens, and spans: array of (start, end, score), code points and the largest marginal."""
    given = docs.sparkSession.sparkContext.broadcast((field, sieve_of(field.marks)))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sieve = given.value
        for part, data, offs in bytetext.pieces(batches, "_text"):
            at, first_byte, end_byte, pointer = tokens(data, offs, model.marks, sieve)
            first = firsts(len(at), pointer)
            p = marginals(emissions(at, first, model), first, model)
            on = p >= SPAN
            begins = np.flatnonzero(on & ~(np.r_[False, on[:-1]] & ~first)) if len(on) else np.zeros(0, np.int64)
            ends = np.flatnonzero(on & ~(np.r_[on[1:], False] & ~np.r_[first[1:], True])) if len(on) else np.zeros(0, np.int64)
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            text = np.searchsorted(pointer, begins, "right") - 1
            base = chars[offs[text]]
            best = np.maximum.reduceat(np.where(on, p, 0), begins) if len(begins) else np.zeros(0)
            structs = pa.StructArray.from_arrays([pa.array((chars[first_byte[begins]] - base).astype(np.int64)), pa.array((chars[end_byte[ends]] - base).astype(np.int64)), pa.array(best)], fields=[*span])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(begins, pointer).astype(np.int32)), structs)
            found = measures(p, pointer)
            sizes = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sizes, pa.array(np.diff(pointer).astype(np.int64)), lists], [*keep, "_measures", "n_tokens", "spans"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    kind = T.ArrayType(T.StructType().add("start", "long").add("end", "long").add("score", "double"))
    out = T.StructType([*rows.drop("_text").schema.fields, T.StructField("_measures", T.ArrayType(T.DoubleType())), T.StructField("n_tokens", T.LongType()), T.StructField("spans", kind)])
    return rows.mapInArrow(run, out)


def scored(docs: DataFrame, field: Field, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of docs, score, predicted, n_tokens and spans, from the column text alone.

    A null text, and one without a word, has the score that the calibration gives to no
    marks, and no spans. Texts are read whole. Repeated rows give repeated results, an
    empty table none; ``keep`` may not name the added columns.
    """
    weights = F.array(*(F.lit(float(w)) for w in field.score))
    product = F.aggregate(F.zip_with("_measures", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-STEEP), F.least(F.lit(STEEP), product))))
    x = measured(docs, field, keep).withColumn("score", score)
    return x.select(*keep, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_tokens", "spans")


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and offending spans of all documents; labels of fold 1 are held out of the fit. A null doc_id is in no fold; the rest is as scored() says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 1)
    found = scored(docs, fit(docs, labels), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted", "n_tokens", "spans")


QUERIES = {"op11_toxicity": op11_toxicity}
SQL: dict[str, str] = {}
