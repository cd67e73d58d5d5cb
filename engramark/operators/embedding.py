"""A static embedder: texts as the mean of the vectors of their pieces, given as a table (piece, vector).

Words are cut by greedy longest match against a trie of the vocabulary, whose pieces
inside a word begin with CONTINUED; a word that can't be cut whole is UNKNOWN. The
vectors stay a table: pieces are joined with it, and means are taken by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramark.functions import text

CONTINUED, UNKNOWN = "##", "[UNK]"
#: Pieces of a vocabulary at most: its trie goes to every task.
MOST_PIECES = 1_000_000
#: Words whose pieces a task remembers.
REMEMBERED = 100_000
WORD = r"[^\s\p{Punct}]+|\p{Punct}"


class Trie:
    """Pieces as nested dictionaries of characters; ``END`` marks a whole piece."""

    END = ""

    def __init__(self, pieces: Iterator[str]) -> None:
        self.first: dict = {}
        self.later: dict = {}
        for piece in pieces:
            node, rest = (self.later, piece[len(CONTINUED) :]) if piece.startswith(CONTINUED) and len(piece) > len(CONTINUED) else (self.first, piece)
            for c in rest:
                node = node.setdefault(c, {})
            if rest:
                node[self.END] = True

    def cut(self, word: str) -> list[str]:
        """The word's pieces, each the longest that fits, or UNKNOWN where one doesn't."""
        out, at = [], 0
        while at < len(word):
            node, end = (self.later if at else self.first), 0
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if self.END in node:
                    end = k + 1
            if not end:
                return [UNKNOWN]
            out.append((CONTINUED if at else "") + word[at:end])
            at = end
        return out


def pieces(rows: DataFrame, column: str, vocabulary: DataFrame, template: str = "{}") -> DataFrame:
    """rows with pieces, the array of the pieces of the lower-cased text in ``template``; a null text has none.

    ``vocabulary`` is (piece, ...); one with more than MOST_PIECES pieces is an error.
    """
    known = [r["piece"] for r in vocabulary.select("piece").where("piece is not null").distinct().limit(MOST_PIECES + 1).collect()]
    if len(known) > MOST_PIECES:
        raise ValueError(f"a vocabulary has at most {MOST_PIECES} pieces")
    given = rows.sparkSession.sparkContext.broadcast(known)
    before, after = template.split("{}")
    said = F.concat(F.lit(before), F.col(column), F.lit(after))
    x = rows.withColumn("_words", F.regexp_extract_all(F.lower(said), F.lit(WORD), F.lit(0)))
    names = [*rows.columns, "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, memo = Trie(given.value), {}
        for batch in batches:
            out = []
            for words in batch.column(batch.num_columns - 1).to_pylist():
                found: list[str] = []
                for w in words or ():
                    if w not in memo:
                        if len(memo) >= REMEMBERED:
                            memo.clear()
                        memo[w] = trie.cut(w)
                    found += memo[w]
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.string()))], names)

    return x.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("pieces", T.ArrayType(T.StringType()))]))


def embedded(rows: DataFrame, column: str, vocabulary: DataFrame, template: str = "{}") -> DataFrame:
    """rows with vector: the mean vector of the text's pieces over its length; zeros where none of them has a vector.

    Equal texts are embedded once. ``vocabulary`` is (piece, vector), vectors of one
    length; of a piece given twice the smaller vector counts. A null text has a null vector.
    """
    of_piece = vocabulary.where("piece is not null and vector is not null").groupBy("piece").agg(F.min(F.col("vector").cast("array<double>")).alias("_v"))
    size = of_piece.agg(F.max(F.size("_v")).alias("n")).first()["n"] or 0
    texts = rows.select(F.col(column).alias("_text")).where("_text is not null").distinct()
    cut = pieces(texts, "_text", vocabulary, template).select("_text", F.explode("pieces").alias("piece"))
    counted = cut.groupBy("_text", "piece").agg(F.count("*").alias("_n"))
    sums = counted.join(of_piece, "piece").groupBy("_text").agg(*(F.sum(F.col("_n") * F.col("_v")[k]).alias(f"_s{k}") for k in range(size)), F.sum("_n").alias("_all"))
    mean = sums.select("_text", F.array(*(F.col(f"_s{k}") / F.col("_all") for k in range(size))).alias("_m"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(size))
    found = rows.join(mean, rows[column] == mean["_text"], "left").withColumn("vector", F.when(F.col(column).isNotNull(), F.coalesce(text.normalized("_m"), zeros)))
    return found.drop("_text", "_m")
