"""Exact removal of repeated byte strings with a sparse suffix array.

A string of ``length`` bytes that starts in two places has an anchor, a position
chosen by its bytes alone, at the same distance in both (anchors.py). Successive
window starts of one anchor are a segment. Spark counts anchors by hash and
segments by a cryptographic digest of their bytes: one that stands elsewhere too is
removed whole, and of equal ones a single one is sorted.
The distinct segments of one anchor hash are compared by sorting the suffixes that
start at their anchors, and the reversed prefixes before them, deep-shallow: for
every group of suffixes with a common prefix, the neighbours in the order of
prefixes give the longest match on the left.

The segments of a hash that has more than GROUP of them are split by their next
anchors, so that no task sorts many. Strings of several lengths go through the same
steps at once: their hashes are kept apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.llm import bytetext, scratch
from engramark.llm.anchors import GRAM, anchors
from engramark.llm.suffix_sort import common_prefix, deep_shallow_order

LENGTH = 400
#: Bytes that passages of over 50 words have at least.
PASSAGE = 250
#: Distinct segments of one hash, of less than twice LENGTH bytes each, that one task sorts.
GROUP = 2048

#: Further anchors by which a larger group is split first.
ANCHORS = 4
#: Parts that a task makes at once.
DEALT = 4096
PLACE = ("length", "key", "doc_id", "start")

Segment = tuple[bytes, int]


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), key, doc_id (0 for null, which the key tells apart) and text: key and doc_id name a row; rows equal in both columns are removed alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    key = F.xxhash64(doc_id.isNull(), doc_id, text)
    return docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), F.coalesce(doc_id, F.lit(0)).alias("doc_id"), text.alias("text"))


def segments(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """hash, content, length, key, doc_id, start, size, anchor: every segment of texts (key, doc_id, text) for strings of each length, with a digest of its bytes and the anchor's distance from its start; no hash has segments of two lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, offs in bytetext.pieces(batches):
                view = memoryview(data)
                for length in lengths:
                    first, last, anchor, hashes = anchors(data, offs, length)
                    hashes = bytetext.mix(hashes + np.uint64(length) * np.uint64(0x9E3779B97F4A7C15))
                    contents = [digest(view[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                    doc = np.searchsorted(offs, first, "right") - 1
                    names = [pa.array(hashes.view(np.int64)), pa.array(contents, pa.binary()), pa.array(np.full(len(first), length, np.int32)), *(rows.column(k).take(pa.array(doc)) for k in (0, 1))]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(first - offs[doc]), pa.array((last - first + length).astype(np.int32)), pa.array((anchor - first).astype(np.int32))], ["hash", "content", "length", "key", "doc_id", "start", "size", "anchor"])

    return texts.select("key", "doc_id", "text").mapInArrow(run, "hash long, content binary, length int, key long, doc_id long, start long, size int, anchor int")


def digest(data: bytes) -> bytes:
    """A cryptographic digest: segments with equal ones have equal bytes."""
    return hashlib.blake2b(data, digest_size=20).digest()


def matches(group: list[Segment], length: int) -> list[tuple[int, int] | None]:
    """For each segment (bytes, anchor), the range of its bytes that windows equal to ones of other segments, at the same distance from the anchor, cover; None where there are none.

    It is one range, as all such windows hold the anchor.
    """
    right = [s[a:] for s, a in group]
    left = [s[a - 1 :: -1] if a else b"" for s, a in group]
    order = deep_shallow_order(right, GRAM)
    longest = max(len(x) for x in left)
    lcp = [common_prefix(right[i], right[j], GRAM) for i, j in zip(order, order[1:], strict=False)]
    rank = [0] * len(group)
    for k, i in enumerate(deep_shallow_order(left)):
        rank[i] = k
    before, after = [0] * len(group), [0] * len(group)
    for begin, end, depth in intervals(lcp):
        if depth + longest < length:
            continue
        members = sorted(order[begin : end + 1], key=rank.__getitem__)
        shared = [0, *(common_prefix(left[i], left[j]) for i, j in zip(members, members[1:], strict=False)), 0]
        for i, low, high in zip(members, shared, shared[1:], strict=False):
            if (most := max(low, high)) + depth >= length:
                before[i], after[i] = max(before[i], most), max(after[i], depth)
    return [(a - low, a + high) if high else None for (_, a), low, high in zip(group, before, after, strict=True)]


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, common prefix) of every maximal range of successive suffixes that share a prefix longer than their neighbours do."""
    stack: list[tuple[int, int]] = []
    for k, depth in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][1] >= depth:
            first, deep = stack.pop()
            if deep > depth:
                yield first, k, deep
        stack.append((first, depth))


def compared(fetched: DataFrame) -> DataFrame:
    """key, doc_id, length, start, end of the ranges in single segments that match another of their hash; rows have hash, n, length, key, doc_id, start, anchor, bytes."""
    names = ["key", "doc_id", "length", "start", "end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, rows = None, [], []

        def out() -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for (key, doc_id, length, start, n), found in zip(rows, matches(group, rows[0][2]) if len(group) > 1 else [None] * len(group), strict=True):
                if n == 1 and found:
                    for column, value in zip(columns, (key, doc_id, length, start + found[0], start + found[1]), strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "length" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

        for batch in batches:
            for hash_, n, length, key, doc_id, start, anchor, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hash_ != now:
                    if group:
                        yield out()
                    now, group, rows = hash_, [], []
                group.append((content, anchor))
                rows.append((key, doc_id, length, start, n))
        if group:
            yield out()

    parts = scratch.shuffle_partitions(fetched.sparkSession)
    sorted_ = fetched.repartition(parts, "hash").sortWithinPartitions("hash").select("hash", "n", *PLACE, "anchor", "bytes")
    return sorted_.mapInArrow(run, "key long, doc_id long, length int, start long, end long")


def next_anchors(content: bytes, taken: list[int], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first, last, anchor, hash): runs of successive windows of a segment with the same next anchor, the position with the least hash that isn't ``taken``; -1 where all are."""
    data = np.frombuffer(content, np.uint8)
    up, down = bytetext.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    hashes = bytetext.mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    low = hashes >> np.uint64(24) << np.uint64(24) | np.arange(len(hashes), dtype=np.uint64)
    low[taken] = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.lib.stride_tricks.sliding_window_view(low, length - GRAM + 1).min(1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(least)], strict=True):
        at = int(least[a]) & 0xFFFFFF
        yield (a, b - 1, at, int(hashes[at])) if at < len(hashes) else (a, b - 1, -1, 0)


def split(fetched: DataFrame, times: int) -> DataFrame:
    """The windows of segments cut at ``times`` further anchors, one after the other: hash now stands for all anchors and their distances, so that equal windows still meet.

    With as many anchors as a window has positions, its hash stands for all of its
    bytes: a group can be split until its segments are few or equal.
    """
    names = ["hash", "content", "n", "length", "key", "doc_id", "start", "anchor", "taken", "bytes"]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows: list[tuple] = []
                for hash_, n, length, key, doc_id, begin, middle, before, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    parts = [(hash_, begin, middle, before, whole)]
                    for _ in range(times):
                        parts = [
                            (_mixed(mixed, h, at - anchor if at >= 0 else 0), start + a, anchor - a, [x - a for x in (*taken, at) if x >= 0], content[a : b + length])
                            for mixed, start, anchor, taken, content in parts
                            for a, b, at, h in next_anchors(content, [anchor, *taken], length)
                        ]
                    rows += [(mixed, digest(part), n, length, key, doc_id, start, anchor, taken, part) for mixed, start, anchor, taken, part in parts]
                    if len(rows) >= DEALT:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return fetched.select("hash", "n", *PLACE, "anchor", "taken", "bytes").mapInArrow(run, "hash long, content binary, n long, length int, key long, doc_id long, start long, anchor int, taken array<int>, bytes binary")


def _mixed(hash_: int, other: int, apart: int) -> int:
    """The hash of a group's part, a signed 64-bit integer."""
    mixed = bytetext.mix(np.array([(hash_ * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F + apart) % (1 << 64)], np.uint64))
    return int(mixed.view(np.int64)[0])


def _distinct(rows: DataFrame, n: Column, *columns: str) -> DataFrame:
    """hash, content, rows, n (added up) and the other columns of one of the rows of each hash and content, whichever comes first."""
    # Columns of their own: a struct's least would be sorted for, not hashed.
    return rows.groupBy("hash", "content").agg(F.count("*").alias("rows"), F.sum(n).alias("n"), *(F.first(c).alias(c) for c in columns))


def _kinds(distinct: DataFrame) -> DataFrame:
    """hash, kinds: how many different segments the hashes have of which some must be compared."""
    return distinct.groupBy("hash").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").drop("least")


def sorted_ranges(fetched: DataFrame, group: int) -> DataFrame:
    """key, doc_id, length, start, end of the ranges in the single segments (n = 1) of each hash that match another of that hash.

    Hashes with more than ``group`` distinct segments are split by further anchors, twice as many
    each time, as often as it takes; each group that is left is sorted in one task.
    """
    wholes, few, now, kinds, times = [], None, fetched, fetched, ANCHORS
    while True:
        some = now.where(F.col("kinds") <= group).select("hash", "n", *PLACE, "anchor", "bytes")
        few = some if few is None else few.unionByName(some)
        hot = now.where(F.col("kinds") > group)
        if kinds.where(F.col("kinds") > group).isEmpty():
            # All groups are sorted at once, those of the parts too: a step for each round would be many small ones.
            return reduce(DataFrame.unionByName, wholes, compared(few))
        parts = scratch.written(split(hot, times), "split-segments")
        # Equal parts of different segments are repeated; one of them goes on.
        same = scratch.written(_distinct(parts, F.col("n"), *PLACE, "anchor", "taken", "bytes"), "split-distinct")
        whole = parts.where("n = 1").join(same.where("rows > 1").select("hash", "content"), ["hash", "content"], "left_semi")
        wholes.append(whole.select(*PLACE, (F.col("start") + F.octet_length("bytes")).alias("end")))
        kinds = _kinds(same)
        now, times = same.join(kinds, "hash"), 2 * times


def repeated_ranges(texts: DataFrame, *lengths: int, group: int = GROUP) -> DataFrame:
    """key, doc_id, length, start, end: for each of the ``lengths``, byte ranges, maybe overlapping, whose union is every byte of a string of so many bytes that starts twice or more."""
    all_ = scratch.written(segments(texts, lengths or (LENGTH,)), "segments")
    # Written, as Spark splits a frequent hash's rows only where no aggregation stands before the join.
    several = scratch.written(all_.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "shared-hashes")
    shared = scratch.written(all_.join(several, "hash", "left_semi"), "shared-segments")
    distinct = scratch.written(_distinct(shared, F.lit(1), *PLACE, "size", "anchor"), "distinct-segments")

    whole = shared.join(distinct.where("n > 1").select("hash", "content"), ["hash", "content"], "left_semi")
    whole = whole.select(*PLACE, (F.col("start") + F.col("size")).alias("end"))

    mixed = distinct.join(_kinds(distinct), "hash")
    content = F.expr("substring(encode(text, 'UTF-8'), cast(start as int) + 1, size)").alias("bytes")
    fetched = _with_text(texts, mixed, ["hash", "n", "kinds", "length", "start", "size", "anchor"])
    fetched = fetched.select("hash", "n", "kinds", *PLACE, "anchor", F.expr("cast(array() as array<int>)").alias("taken"), content)
    fetched = scratch.written(fetched, "segment-bytes")
    return whole.unionByName(sorted_ranges(fetched, group))


def _with_text(texts: DataFrame, places: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of ``places`` with key, doc_id and the text of each row of ``texts`` that they name."""
    wanted = places.groupBy("key", "doc_id").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.select("key", "doc_id", "text").join(wanted, ["key", "doc_id"]).select("key", "doc_id", "text", F.explode("wanted").alias("x")).select("key", "doc_id", "text", "x.*")


def merged(ranges: DataFrame) -> DataFrame:
    """key, doc_id, length, start, end: the maximal runs of bytes that ranges of each length cover; ranges that touch are one run."""
    order = Window.partitionBy("key", "doc_id", "length").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Dealt by row alone, as the callers' next step wants it.
    opens = ranges.repartition("key", "doc_id").withColumn("opens", F.when(far >= F.col("start"), 0).otherwise(1))
    runs = opens.withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "doc_id", "length", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def with_spans(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """row (all columns of ``docs``), doc_id, text and spans, the merged byte runs [start, end) to remove from the text's UTF-8.

    With ``passage``, also passages: the runs that strings of so many bytes give.

    A null text is empty; texts of fewer than ``length`` bytes have no spans; a null
    doc_id is a document like any other; repeated rows repeat their strings, so all
    of them lose theirs; an empty table gives no rows; other columns stay in row.
    """
    spark, texts = docs.sparkSession, keyed(docs)
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    kinds = {"spans": length} if passage is None else {"passages": passage, "spans": length}

    def runs(size: int) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("length") == size, F.struct("start", "end"))))

    def lists() -> DataFrame:
        found = merged(repeated_ranges(texts.select("key", "doc_id", "text"), *dict.fromkeys(kinds.values())))
        return found.groupBy("key", "doc_id").agg(*(runs(size).alias(name) for name, size in kinds.items()))

    known = scratch.settled(spark, "spans", lists)
    result = texts.join(known, ["key", "doc_id"], "left")
    return result.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), "text", *(F.coalesce(name, none).alias(name) for name in kinds))


def kept_bytes(raw: bytes, spans: list[dict]) -> bytes:
    parts, at = [], 0
    for s in spans:
        parts.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, raw[at:]])


def kept_text(text: str, spans: list[dict]) -> str:
    """The text without the runs, each made smaller where it would cut a character."""
    raw = text.encode()
    whole = []
    for s in spans:
        start, end = s["start"], s["end"]
        while start < len(raw) and raw[start] & 0xC0 == 0x80:
            start += 1
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if start < end:
            whole.append({"start": start, "end": end})
    return kept_bytes(raw, whole).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings taken out of text, in whole characters; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept_text(t, s) if s else t for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "kept"])

    spans = with_spans(docs, length).select("row", "text", "spans")
    cut = spans.mapInArrow(run, spans.select("row").schema.add("kept", "string"))
    return cut.select(*(F.when(F.col("row.text").isNotNull(), F.col("kept")).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of LENGTH bytes, and as n_passage_bytes what repeated passages of PASSAGE bytes and more cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, spans, passages in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = text.encode()
                removed, covered = (sum(s["end"] - s["start"] for s in x) for x in (spans, passages))
                for column, value in zip(columns, (len(raw), removed, len(spans), hashlib.sha256(kept_bytes(raw, spans)).hexdigest(), covered), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(columns))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes"])

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_spans(docs, LENGTH, PASSAGE).select("doc_id", "text", "spans", "passages").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
