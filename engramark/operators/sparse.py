"""Sparse vectors as rows (k, i, c): all pairs above a cosine, exactly, without a pair for every two that share a frequent dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramark.operators.graph import reliable

#: Steps of the lengths of what is left of a vector.
LEVELS = 64
SLACK = 1e-9


def candidates(vectors: DataFrame, threshold: float, by: tuple[str, ...] = (), fresh: DataFrame | None = None) -> DataFrame:
    """u < v: pairs that may reach the threshold, of normalized vectors with equal columns ``by``; each once. With ``fresh`` (k) only those of which one is fresh.

    Dimensions are ordered by how many vectors have them, the rare first. Of two near
    vectors what is left from the first shared dimension on, in that order, is in both
    long enough for the product of the lengths to reach the threshold. So a vector meets
    in a dimension only those whose rest has one of the levels that its own rest needs: names that have
    nothing but a frequent last word in common don't meet.
    """
    rarity = vectors.groupBy(*by, "i").agg(F.count("*").alias("df"))
    order = Window.partitionBy(*by, "k").orderBy("df", "i")
    before = F.coalesce(F.sum(F.col("c") * F.col("c")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - before))
    x = vectors.join(rarity, [*by, "i"]).withColumn("rest", rest).where(F.col("rest") >= threshold - SLACK)
    level = F.least(F.lit(LEVELS), F.floor(F.col("rest") * LEVELS + SLACK)).cast("int")
    first = reliable(x.select(*by, "i", "k", "rest", level.alias("level")))
    needed = F.greatest(F.lit(0), F.floor(LEVELS * (threshold - 2 * SLACK) / F.col("rest"))).cast("int")
    # Of two near vectors each has a level that the other needs, so that it is enough for one of them to look for the other.
    looking = first.where(needed <= LEVELS) if fresh is None else first.where(needed <= LEVELS).join(fresh.select("k").distinct(), "k", "left_semi")
    seeking = looking.select(*by, "i", F.col("k").alias("u"), F.explode(F.sequence(needed, F.lit(LEVELS))).alias("level"))
    met = seeking.join(first.select(*by, "i", F.col("k").alias("v"), "level"), [*by, "i", "level"])
    if fresh is None:
        return met.where("u < v").select(*by, "u", "v").distinct()
    return met.where("u <> v").select(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def dots(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (u, v) with cosine, of pairs that share a dimension."""
    one, two = vectors.select(F.col("k").alias("u"), "i", F.col("c").alias("cu")), vectors.select(F.col("k").alias("v"), "i", F.col("c").alias("cv"))
    return pairs.join(one, "u").join(two, ["v", "i"]).groupBy("u", "v").agg(F.sum(F.col("cu") * F.col("cv")).alias("cosine"))


def pairs(vectors: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, cosine): all pairs u < v of normalized vectors with at least the threshold, which is above 0; k is of one group of ``by`` only."""
    return dots(candidates(vectors, threshold, by).select("u", "v"), vectors).where(F.col("cosine") >= threshold - SLACK)
