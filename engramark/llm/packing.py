"""Best-fit packing of token sequences by linear grouping.

Large lengths are split into groups of equal cardinality and rounded up to the
longest of their group; configurations of the few rounded lengths are optimised by a
linear programme, whose columns a knapsack finds, and what its whole parts leave is
filled up; actual documents take the places (a place of a rounded length holds any
document of its group), and the small ones are best-fitted into what is left. A plan
that only fills up, over more groups, is made too, and the one of fewer sequences taken.
Only the histogram of lengths, at most ``capacity`` numbers whatever the corpus,
reaches the driver; places are handed back to documents by their rank within
their length, in parallel.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.llm import scratch

CAPACITY = 1024
END_ID = 2
#: Lengths above this part of the capacity are large: they are grouped and get configurations.
LARGE_PART = 16
#: Groups of the linear programme, and of the plan that only fills up.
FEW, GROUPS = 96, 512
#: Marks the one special token of the vocabulary, which the tokenizer recognises inside texts.
SPECIAL = "<|endoftext|>"

_loaded: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """A function from a text to its ids, as tokenizers gives them for the vocabulary in ``path``.

    The vocabulary's merges run in tiktoken, which is several times as fast, on
    texts of ASCII and Latin letters, where both libraries split words alike; any
    other text, and one that holds the special token, goes to tokenizers itself.
    """
    if path not in _loaded:
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {x["content"] for x in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        other = re.compile(r"[^\t-\r\x20-\x7e -ɏ‐-‧€]")

        def encode(text: str) -> list[int]:
            if SPECIAL in text or other.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _loaded[path] = encode
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Texts longer than ``capacity`` ids are cut; the first piece takes the remainder."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                tokens = np.array([*encode(texts[i].as_py() or ""), end_id], "<u4")
                doc, raw = ids[i].as_py(), memoryview(tokens).cast("B")
                first = len(tokens) % capacity or capacity
                start = 0
                for piece, end in enumerate(range(first, len(tokens) + 1, capacity)):
                    for column, value in zip(rows, (doc, piece, start, end - start, zlib.crc32(raw[4 * start : 4 * end])), strict=True):
                        column.append(value)
                    start = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Linear grouping: each length's rounded length, the longest of its group; groups have equal numbers of documents as far as lengths allow."""
    each = max(1, -(-sum(counts.values()) // groups))
    rounded, top, filled = {}, None, 0
    for length in sorted(counts, reverse=True):
        if top is None or filled >= each:
            top, filled = length, 0
        rounded[length] = top
        filled += counts[length]
    return rounded


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, times): sets of rounded lengths that together hold all ``counts``.

    The longest left is completed to the fullest sum that what is left allows
    (a subset-sum table over the distinct lengths, longest first), and the set is
    repeated as often as its lengths last.
    """
    left, found = dict(counts), []
    while left:
        longest = max(left)
        best = fullest(left, longest, capacity)
        used: dict[int, int] = {}
        for x in best:
            used[x] = used.get(x, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        found.append((best, times))
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return found


def fullest(left: dict[int, int], first: int, capacity: int) -> list[int]:
    """``first`` and further lengths of ``left`` with the largest sum up to the capacity, preferring long ones."""
    room = capacity - first
    chosen = [first]
    sizes = [x for x in sorted(left, reverse=True) if x <= room and left[x] > (x == first)]
    masks, reach, full = [], 1, (1 << (room + 1)) - 1
    for x in sizes:
        masks.append(reach)
        for _ in range(min(left[x] - (x == first), room // x)):
            grown = reach | (reach << x) & full
            if grown == reach:
                break
            reach = grown
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for k in range(len(masks) - 1, -1, -1):
        while not masks[k] >> at & 1:
            chosen.append(sizes[k])
            at -= sizes[k]
    return chosen


def fractional(counts: dict[int, int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations (how many of each length, longest first) and how often to take them: the least total that holds all ``counts``, in parts.

    Column generation: the prices of lengths in the present basis make a knapsack, whose
    best filling enters while it is worth more than a sequence.
    """
    sizes = np.array(sorted(counts, reverse=True))
    demand = np.array([counts[x] for x in sizes.tolist()], float)
    basis = np.diag(capacity // sizes).astype(float)
    times = demand / basis.diagonal()
    for _ in range(40 * len(sizes)):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(sizes[-1]), capacity + 1):
            k = int(np.searchsorted(-sizes, -room))  # the first size that fits
            gain = worth[room - sizes[k:]] + prices[k:]
            best = int(gain.argmax())
            worth[room], last[room] = (gain[best], k + best) if gain[best] > worth[room - 1] else (worth[room - 1], -1)
        if worth[capacity] <= 1 + 1e-9:
            break
        column, room = np.zeros(len(sizes)), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= int(sizes[last[room]])
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        times = np.maximum(0, times - ratio[leaves] * step)
        times[leaves] = ratio[leaves]
        basis[:, leaves] = column
    return [(basis[:, k].astype(int), float(times[k])) for k in range(len(sizes))]


def optimised(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, times) as configurations() gives them: the whole parts of the best fractional ones, and the rest filled up."""
    if not counts:
        return []
    left, found = dict(counts), []
    sizes = sorted(counts, reverse=True)
    for column, times in sorted(fractional(counts, capacity), key=lambda c: -c[1]):
        whole = min([int(times + 1e-6), *(left[x] // int(n) for x, n in zip(sizes, column, strict=True) if n)])
        if whole > 0 and column.any():
            found.append(([x for x, n in zip(sizes, column, strict=True) for _ in range(int(n))], whole))
            for x, n in zip(sizes, column, strict=True):
                left[x] -= int(n) * whole
    return found + configurations({x: n for x, n in left.items() if n}, capacity)


def plan_places(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, few: int = FEW, large_part: int = LARGE_PART) -> np.ndarray:
    """The plan of fewer sequences, of the optimised configurations of few groups and of those that only fill up."""
    plans = [_places(counts, capacity, few, large_part, optimised), _places(counts, capacity, groups, large_part, configurations)]
    return min(plans, key=lambda p: int((p[:, 2] + p[:, 3]).max(initial=0)))


def _places(counts: dict[int, int], capacity: int, groups: int, large_part: int, configured) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset): the documents of a length, in rank order, take these places.

    Every document gets one place; a row gives ``times`` documents the same offset
    in as many successive sequences. The rows grow with the square of the capacity
    at most, not with the number of documents.
    """
    large = {x: n for x, n in counts.items() if x * large_part > capacity}
    small = {x: n for x, n in counts.items() if x not in large}
    rounded = grouped(large, groups)
    of_group: dict[int, list[list[int]]] = {}
    for length in sorted(large, reverse=True):
        of_group.setdefault(rounded[length], []).append([length, large[length]])
    totals = {top: sum(n for _, n in members) for top, members in of_group.items()}
    rank = dict.fromkeys(counts, 0)
    places: list[tuple[int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> runs of sequences (first, times)
    sequence = 0
    for lengths, times in configured(totals, capacity):
        done = 0
        while done < times:
            # As many sequences as the current actual lengths of all places last.
            need: dict[int, int] = {}
            for top in lengths:
                need[top] = need.get(top, 0) + 1
            step = times - done
            for top, k in need.items():
                step = min(step, max(1, of_group[top][0][1] // k))
            offset = 0
            for top in lengths:
                members = of_group[top]
                length, n = members[0]
                take = min(step, n)
                step = take
                places.append((length, rank[length], take, sequence, offset))
                rank[length] += take
                members[0][1] -= take
                if not members[0][1]:
                    members.pop(0)
                offset += length
            if offset < capacity:
                rooms.setdefault(capacity - offset, []).append((sequence, step))
            sequence += step
            done += step
    levels = sorted(rooms)
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            at = bisect.bisect_left(levels, length)
            if at == len(levels):
                fits = capacity // length
                first, times, room = sequence, -(-n // fits), capacity
                sequence += times
            else:
                room = levels[at]
                first, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    levels.pop(at)
            per = min(room // length, max(1, n // times)) if n >= times else 1
            take = min(times, n)
            for k in range(per):
                places.append((length, rank[length], take, first, capacity - room + k * length))
                rank[length] += take
                n -= take
            for seq, runs, rest in ((first, take, room - per * length), (first + take, times - take, room)):
                if runs and rest:
                    if rest not in rooms:
                        bisect.insort(levels, rest)
                    rooms.setdefault(rest, []).append((seq, runs))
    return np.array(places, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, places: np.ndarray) -> DataFrame:
    """Adds sequence_id and offset to pieces that have (length, rank)."""
    spark = pieces.sparkSession
    order = np.lexsort((places[:, 1], places[:, 0]))
    table = spark.sparkContext.broadcast(places[order])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.mapInArrow(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens.

    A null or empty text is one end token; a null doc_id stays null; repeated rows
    are documents of their own; an empty table gives no rows; columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    cut = scratch.written(token_pieces(docs, tokenizer, capacity).withColumn("part", F.spark_partition_id()), "pack-pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan_places(counts, capacity, groups)
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("within"))
    return place(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), places)


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_pack": op3_pack}
SQL: dict[str, str] = {}
