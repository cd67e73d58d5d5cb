"""Canonicalization of surface forms: leader clustering, per-source labels, consolidation across sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators.graph import connected


def identity(forms: DataFrame) -> DataFrame:
    return forms.withColumn("label", F.col("input"))


def stub(forms: DataFrame) -> DataFrame:
    return forms.withColumn("label", text.stub_bucket("input"))


def first_writer(forms: DataFrame, *scope: str) -> DataFrame:
    """The input that first had the same tokens, within ``scope``: token clustering where no two different token sets are near."""
    order = F.struct("seq", "input")
    first = forms.withColumn("tokens", text.token_key("input"))
    leader = first.groupBy(*scope, "tokens").agg(F.min(order)["input"].alias("label"))
    return first.join(leader, [*scope, "tokens"]).drop("tokens")


DIM = 4096


def leader_clusters(forms: DataFrame, threshold: float = 0.7, guarded: bool = True, weights: tuple[float, float] = (1.0, 0.0), index: str = "linear") -> DataFrame:
    """Sequential clustering, one source at a time: each new input takes the label of the nearest earlier label, the first of equals, if it is near enough and the two may merge, and else becomes one.

    Nearness is the cosine of hashed token counts, of a given column ``vector``, or of
    both joined with ``weights``. ``index`` hashed looks only at labels that share a
    token or one of eight signs of the vector's planes; linear at all. Only each
    source's distinct inputs go to Python, in order of first occurrence; each depends
    on all before, so that a source is one task's, whose memory its labels bound.
    """
    import pandas as pd

    with_vector = weights[1] > 0
    columns = [F.min("seq").alias("seq"), *([F.min_by("vector", "seq").alias("vector")] if with_vector else [])]
    distinct = forms.groupBy("source_id", "input").agg(*columns)
    distinct = distinct.withColumn("tokens", text.tokens("input")).withColumn("words", text.words("input")).withColumn("digits", F.regexp_extract_all("input", F.lit(r"(\d+)"), F.lit(1)))
    distinct = distinct.withColumn("buckets", F.transform("tokens", text.token_bucket)).withColumn("signs", F.transform("tokens", text.token_sign))
    trailing = set(text.TRAILING_WORDS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        def may_merge(a: int, b: int) -> bool:
            if rows["digits"][a] != rows["digits"][b]:
                return False
            x, y = sorted((rows["words"][a], rows["words"][b]), key=len)
            return not (len(y) == len(x) + 1 and y[:-1] == x and y[-1] in trailing)

        pdf = pdf.sort_values("seq", ignore_index=True)
        rows = {c: [list(x) for x in pdf[c]] for c in ("words", "digits", "buckets", "signs")}
        by_bucket: dict[int, list[tuple[int, float]]] = {}
        by_plane: dict[tuple[int, int], list[int]] = {}
        leaders: list[int] = []
        out = []
        vectors = np.stack([np.asarray(v, float) for v in pdf["vector"]]) if with_vector else None
        if with_vector:
            length = np.sqrt((vectors**2).sum(1, keepdims=True))
            vectors = np.divide(vectors, length, out=vectors, where=length > 0)
            sides = (vectors @ np.random.default_rng(1).normal(size=(vectors.shape[1], 32)) > 0).reshape(len(vectors), 8, 4) @ (1 << np.arange(4))
        for k in range(len(pdf)):
            bag: dict[int, float] = {}
            for bucket, sign in zip(rows["buckets"][k], rows["signs"][k], strict=True):
                bag[bucket] = bag.get(bucket, 0.0) + sign
            norm = sum(v * v for v in bag.values()) ** 0.5
            bag = {b: v / norm for b, v in bag.items()} if norm else {}
            own = [weights[0] ** 2 * bool(bag), weights[1] ** 2 * bool(with_vector and length[k] > 0)]
            cosines = np.zeros(len(leaders))
            for bucket, v in bag.items():
                for j, w in by_bucket.get(bucket, ()):
                    cosines[j] += v * w
            cosines *= weights[0] ** 2
            if with_vector and leaders:
                if index == "hashed":
                    near = sorted({j for t in range(8) for j in by_plane.get((t, int(sides[k][t])), ())} | set(np.flatnonzero(cosines).tolist()))
                else:
                    near = range(len(leaders))
                if len(near):
                    cosines[near] += weights[1] ** 2 * (vectors[[leaders[j] for j in near]] @ vectors[k])
            if leaders:
                cosines /= np.sqrt(np.array([n for *_, n in norms])) * sum(own) ** 0.5 + (sum(own) == 0)
                best = int(np.flatnonzero(cosines > cosines.max() - 1e-12)[0])
                if cosines[best] >= threshold - 1e-12 and (not guarded or may_merge(k, leaders[best])):
                    out.append(pdf["input"][leaders[best]])
                    continue
            else:
                norms: list[tuple[float]] = []
            for bucket, v in bag.items():
                by_bucket.setdefault(bucket, []).append((len(leaders), v))
            if with_vector:
                for t in range(8):
                    by_plane.setdefault((t, int(sides[k][t])), []).append(len(leaders))
            leaders.append(k)
            norms.append((sum(own) or 1.0,))
            out.append(pdf["input"][k])
        return pd.DataFrame({"source_id": pdf["source_id"], "input": pdf["input"], "label": out})

    found = distinct.groupBy("source_id").applyInPandas(run, "source_id string, input string, label string")
    return forms.join(found, ["source_id", "input"])


def pre_seeded(forms: DataFrame, known: DataFrame, **settings) -> DataFrame:
    """forms with labels from the map ``known`` (alias, canonical), and those it lacks clustered after its canonicals, which come first."""
    mapped = forms.join(F.broadcast(known) if known.isLocal() else known, forms["input"] == known["alias"], "left")
    rest = mapped.where("canonical is null").drop("alias", "canonical")
    seeds = known.select("canonical").distinct().crossJoin(rest.select("source_id").distinct())
    seeds = seeds.select(F.lit(-1).cast("long").alias("seq"), "source_id", F.col("canonical").alias("input"))
    found = leader_clusters(rest.select("seq", "source_id", "input").unionByName(seeds), **settings).where("seq >= 0").select("seq", "source_id", "input", "label")
    return found.unionByName(mapped.where("canonical is not null").select("seq", "source_id", "input", F.col("canonical").alias("label")))


def consolidated(labels: DataFrame, jaccard: float = 0.5, min_overlap: int = 2, min_aliases: int = 2) -> DataFrame:
    """source_id, label, merged: labels of different sources that share enough aliases become one class, named by its least (source, label).

    Candidate pairs come from an equi-join on shared aliases, counted, so that pairs
    without one are never made.
    """
    key = F.concat_ws("::", "source_id", "label")
    alias = labels.select(key.alias("k"), "source_id", F.lower("input").alias("alias")).distinct()
    sized = alias.join(alias.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= min_aliases), "k")
    a, b = sized.alias("a"), sized.alias("b")
    shared = a.join(b, (F.col("a.alias") == F.col("b.alias")) & (F.col("a.k") < F.col("b.k")) & (F.col("a.source_id") != F.col("b.source_id")))
    pairs = shared.groupBy(F.col("a.k").alias("u"), F.col("b.k").alias("v"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(F.count("*").alias("common"))
    edges = pairs.where((F.col("common") >= min_overlap) & (F.col("common") >= jaccard * (F.col("na") + F.col("nb") - F.col("common")))).select("u", "v")
    roots = connected(edges)
    every = labels.select("source_id", "label", key.alias("k")).distinct()
    return every.join(roots, every["k"] == roots["node"], "left").select("source_id", "label", F.coalesce("component", "k").alias("merged"))


def noise(forms: DataFrame, rate: float, seed: int = 7) -> DataFrame:
    """Changes round(n rate) rows, those with the least draws: another source, another spelling, or a shorter input.

    The draw at that rank is found by an aggregate over draws' counts, not by ordering all rows in one place.
    """
    drawn = forms.withColumn("_draw", text.uniform(seed, F.col("seq"))).withColumn("_bin", F.floor(F.col("_draw") * 4096))
    bins = drawn.groupBy("_bin").agg(F.count("*").alias("_n"))
    total = Window.orderBy("_bin")
    bins = bins.withColumn("_before", F.sum("_n").over(total) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_bin").orderBy("_draw", "seq")) + F.col("_before")
    x = drawn.join(F.broadcast(bins), "_bin").withColumn("_on", rank <= F.bround(F.col("_all") * rate))
    mode = text.uniform(seed + 1, F.col("seq"))
    changed = F.when(mode < 1 / 3, F.col("input")).when(mode < 2 / 3, F.upper("input")).otherwise(F.expr("left(input, greatest(1, length(input) - 1))"))
    source = F.when(F.col("_on") & (mode < 1 / 3), F.concat("source_id", F.lit("-swapped"))).otherwise(F.col("source_id"))
    return x.withColumn("noisy_input", F.when(F.col("_on"), changed).otherwise(F.col("input"))).withColumn("noisy_source", source).drop("_draw", "_bin", "_n", "_before", "_all", "_on")


def replicated(forms: DataFrame, copies: int) -> DataFrame:
    """The rows once as they are and ``copies`` times with a suffix on input and oracle."""
    spark = forms.sparkSession
    numbered = forms.join(F.broadcast(spark.range(copies + 1).withColumnRenamed("id", "copy")))
    suffix = F.when(F.col("copy") == 0, "").otherwise(F.concat(F.lit("_v"), (F.col("copy") - 1).cast("string")))
    return numbered.withColumn("input", F.concat("input", suffix)).withColumn("oracle", F.concat("oracle", suffix))


def held_out(forms: DataFrame, share: float, seed: int = 11) -> DataFrame:
    """Adds held: the rows with the least draws of each oracle, one at least, none of an oracle with one row."""
    group = Window.partitionBy("oracle")
    rank = F.row_number().over(group.orderBy(text.uniform(seed, F.col("seq")), "seq"))
    n = F.count("*").over(group)
    return forms.withColumn("held", (n > 1) & (rank <= F.greatest(F.lit(1), F.bround(n * share).cast("int"))))
