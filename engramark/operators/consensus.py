"""Consensus across sources: which of their local labels mean the same, from shared aliases and from near centroids.

Writes are (seq, source_id, input, label), and vector (one for each write) where
centroids are asked for. A label of a source is a key, written source::label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramark.operators import dense
from engramark.operators.graph import connected, reliable

JACCARD, COSINE, MIN_ALIASES, MIN_OVERLAP = 0.5, 0.85, 2, 2
#: Share of strong pairs from which on keys of one alias may merge too, and share of such keys from which on equal aliases do.
STRONG_DENSITY, SINGLE_SHARE = 0.02, 0.7


def keys(writes: DataFrame) -> DataFrame:
    """k, source_id, label, place (of the first write) and n, the number of different inputs, of every key."""
    x = writes.groupBy("source_id", "label").agg(F.min("seq").alias("place"), F.countDistinct("input").alias("n"))
    return x.withColumn("k", F.concat_ws("::", "source_id", "label"))


def alias_pairs(writes: DataFrame, min_aliases: int, touched: DataFrame | None = None) -> DataFrame:
    """u, v, common and jaccard of keys of different sources that share an alias, the earlier one first; with ``touched`` (k) those of which one is touched.

    Pairs come from an equi-join on aliases; one that very many keys have makes as many
    pairs as it stands for.
    """
    big = keys(writes).where(F.col("n") >= min_aliases)
    alias = writes.select("source_id", "label", "input").distinct().join(big, ["source_id", "label"])
    if touched is not None:
        # Only aliases of a touched key are joined, and of those that meet one has to be touched.
        alias = alias.join(touched.select("k", F.lit(True).alias("new")), "k", "left")
        alias = alias.join(alias.where("new").select("input").distinct(), "input", "left_semi")
    a, b = alias.alias("a"), alias.alias("b")
    earlier = (F.col("a.place") < F.col("b.place")) | ((F.col("a.place") == F.col("b.place")) & (F.col("a.k") < F.col("b.k")))
    on = (F.col("a.input") == F.col("b.input")) & (F.col("a.source_id") != F.col("b.source_id")) & earlier
    met = a.join(b, on if touched is None else on & (F.col("a.new") | F.col("b.new")))
    x = met.groupBy(F.col("a.k").alias("u"), F.col("b.k").alias("v"), F.col("a.place").alias("pu"), F.col("b.place").alias("pv"), F.col("a.n").alias("nu"), F.col("b.n").alias("nv")).agg(F.count("*").alias("common"))
    return x.withColumn("jaccard", F.col("common") / (F.col("nu") + F.col("nv") - F.col("common")))


def centroids(writes: DataFrame) -> DataFrame:
    """k, i, c: the normalized mean vector of all writes of each key, a row for each dimension that isn't 0; a mean of zeros has none."""
    x = writes.select(F.concat_ws("::", "source_id", "label").alias("k"), F.posexplode("vector").alias("i", "w"))
    m = x.groupBy("k", "i").agg(F.avg(F.col("w").cast("double")).alias("m")).where("m <> 0")
    norm = m.groupBy("k").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(norm, "k").select("k", "i", (F.col("m") / F.col("norm")).alias("c"))


def near_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """u < v and cosine of normalized vectors (k, i, c) with at least the threshold, exactly: as dense vectors, in blocks around pivots."""
    size = vectors.agg(F.max("i").alias("n")).first()["n"]
    of = vectors.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "c"))).alias("m"))
    whole = of.select(F.col("k").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(size or 0)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vector"))
    between, members, _ = dense.pairs(dense.packed(whole), threshold)
    return dense.expanded(between, members)


def _with_cosine(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    one, two = vectors.select(F.col("k").alias("u"), "i", F.col("c").alias("cu")), vectors.select(F.col("k").alias("v"), "i", F.col("c").alias("cv"))
    dots = pairs.select("u", "v").join(one, "u").join(two, ["v", "i"]).groupBy("u", "v").agg(F.sum(F.col("cu") * F.col("cv")).alias("cosine"))
    return pairs.join(dots, ["u", "v"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def judged_pairs(writes: DataFrame, rule: str, jaccard: float = JACCARD, cosine: float = COSINE, min_aliases: int = MIN_ALIASES, min_overlap: int = MIN_OVERLAP, touched: DataFrame | None = None) -> DataFrame:
    """u, v, pu, pv and reason of pairs of keys of at least ``min_aliases`` aliases, of different sources, that the rule looks at.

    Rule any takes jaccard_only, cosine_only and both; rule all takes and_passed, and gives
    the other reasons of pairs with ``min_overlap`` common aliases. Rule all can be confined to
    pairs of which one key is ``touched`` (k).
    """
    if touched is not None and rule != "all":
        raise ValueError("only rule all can be confined to touched keys")
    shared = alias_pairs(writes, min_aliases, touched)
    if touched is not None:
        shared = reliable(shared)
        ends = shared.select(F.col("u").alias("k")).union(shared.select("v")).distinct()
        writes = writes.join(ends, F.concat_ws("::", "source_id", "label") == ends["k"], "left_semi")
    vectors = reliable(centroids(writes))
    if rule == "all":
        x = _with_cosine(shared.where(F.col("common") >= min_overlap), vectors)
        j, c = F.col("jaccard") >= jaccard, F.col("cosine") >= cosine - 1e-12
        return x.select("u", "v", "pu", "pv", F.when(j & c, "and_passed").when(j, "blocked_cosine_below").when(c, "blocked_jaccard_below").otherwise("blocked_both").alias("reason"))
    big = keys(writes).where(F.col("n") >= min_aliases).select("k", "source_id", "place")
    near = near_pairs(vectors.join(big.select("k"), "k", "left_semi"), cosine).select("u", "v")
    ends = near.join(big.select(F.col("k").alias("u"), F.col("source_id").alias("su"), F.col("place").alias("pu")), "u").join(big.select(F.col("k").alias("v"), F.col("source_id").alias("sv"), F.col("place").alias("pv")), "v").where("su <> sv")
    turned = (F.col("pv") < F.col("pu")) | ((F.col("pv") == F.col("pu")) & (F.col("v") < F.col("u")))
    ends = ends.select(*(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("u", "v"), ("v", "u"), ("pu", "pv"), ("pv", "pu"))), F.lit(True).alias("c"))
    x = shared.where(F.col("jaccard") >= jaccard).select("u", "v", "pu", "pv", F.lit(True).alias("j")).join(ends, ["u", "v", "pu", "pv"], "full")
    return x.select("u", "v", "pu", "pv", F.when(F.col("j") & F.col("c"), "both").when(F.col("j"), "jaccard_only").otherwise("cosine_only").alias("reason"))


def roots(edges: DataFrame) -> DataFrame:
    """k, root of every key in edges (u, v, pu, pv): classes are joined edge by edge in order, each time under the root of the earlier key's class."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[str, str] = {}

        def find(k: str) -> str:
            parent.setdefault(k, k)
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        for u, v in pdf.sort_values(["pu", "u", "pv", "v"])[["u", "v"]].itertuples(index=False):
            a, b = find(u), find(v)
            if a != b:
                parent[b] = a
        return pd.DataFrame({"k": list(parent), "root": [find(k) for k in parent]})

    groups = connected(edges.select("u", "v")).select(F.col("node").alias("u"), "component")
    return edges.join(groups, "u").groupBy("component").applyInPandas(lambda pdf: run(pdf), "k string, root string")


def merged(writes: DataFrame, pairs: DataFrame) -> DataFrame:
    """source_id, label and merged for every key: ``merged::`` and the local label of its class's root, or source::label of a key alone."""
    every = keys(writes)
    found = roots(pairs.where(F.col("reason").isin("jaccard_only", "cosine_only", "both", "and_passed")))
    names = found.join(every.select(F.col("k").alias("root"), F.col("label").alias("name")), "root").select("k", F.concat(F.lit("merged::"), "name").alias("merged"))
    return every.join(names, "k", "left").select("k", "source_id", "label", "n", F.coalesce("merged", "k").alias("merged"))


def eligible_pairs(writes: DataFrame, min_aliases: int) -> DataFrame:
    """One number: pairs of keys of different sources with at least ``min_aliases`` aliases, from counts for each source."""
    of = keys(writes).where(F.col("n") >= min_aliases).groupBy("source_id").agg(F.count("*").alias("c"))
    return of.agg(((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))


def reason_counts(writes: DataFrame, jaccard: float = JACCARD, cosine: float = COSINE, min_aliases: int = MIN_ALIASES, min_overlap: int = MIN_OVERLAP) -> DataFrame:
    """reason and n of rule all over all eligible pairs: those with fewer than ``min_overlap`` common aliases are the rest of the number of all, so that they are never made."""
    judged = judged_pairs(writes, "all", jaccard, cosine, min_aliases, min_overlap).groupBy("reason").agg(F.count("*").alias("n"))
    judged = reliable(judged)
    looked_at = judged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rest = eligible_pairs(writes, min_aliases).crossJoin(looked_at).select(F.lit("blocked_overlap_below_min").alias("reason"), (F.coalesce("pairs", F.lit(0)).cast("long") - F.col("n")).alias("n"))
    return judged.unionByName(rest.where("n > 0"))


def adaptive(writes: DataFrame, jaccard: float = JACCARD, cosine: float = COSINE) -> tuple[DataFrame, dict]:
    """Rule all with the settings that the density of strong pairs asks for, and what was chosen."""
    strong = judged_pairs(writes, "all", jaccard, cosine).where("reason = 'and_passed'").count()
    total = eligible_pairs(writes, MIN_ALIASES).first()["pairs"] or 0
    density = strong / total if total else 0.0
    least = 1 if density >= STRONG_DENSITY else MIN_ALIASES
    chosen = {"density": density, "min_aliases": least, "kind": "global_stratum_heavy" if density >= STRONG_DENSITY else "ambiguity_heavy"}
    return merged(writes, judged_pairs(writes, "all", jaccard, cosine, least, MIN_OVERLAP)), chosen


def _starts(x: Column) -> Column:
    """The first three characters of a name, or all of fewer."""
    return F.left(x, F.lit(3))


def _parts(x: Column) -> Column:
    """All strings of one to three characters of a name."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(x) - n + 1)), lambda i: x.substr(i, n)))))


def identity_merges(every: DataFrame, writes: DataFrame) -> DataFrame:
    """merged()'s rows with keys of one alias, not merged so far, named by it where that is most keys' state.

    Equal aliases of several keys become ``merged-identity::`` and the alias, that of one
    key the alias alone; neither where a member's source has another label that
    contains the alias or stands in it, in any case. Such labels are found by the
    strings of up to three characters at which one starts in the other.
    """
    share = every.agg(F.avg((F.col("n") == 1).cast("double")).alias("share")).first()["share"] or 0.0
    if share < SINGLE_SHARE:
        return every
    alias = writes.groupBy("source_id", "label").agg(F.min("input").alias("alias"))
    single = every.where((F.col("n") == 1) & (F.col("merged") == F.col("k"))).join(alias, ["source_id", "label"])
    labels = every.select("source_id", F.col("label").alias("other")).distinct()
    low_a, low_o = F.lower("alias"), F.lower("other")
    inside = single.select("k", "source_id", "alias", _starts(low_a).alias("s")).join(labels.select("source_id", "other", F.explode(_parts(low_o)).alias("s")), ["source_id", "s"]).where(F.contains(low_o, low_a))
    around = labels.select("source_id", "other", _starts(low_o).alias("s")).join(single.select("k", "source_id", "alias", F.explode(_parts(low_a)).alias("s")), ["source_id", "s"]).where(F.contains(low_a, low_o))
    unsafe = inside.select("alias", "other").union(around.select("alias", "other")).where("alias <> other").select("alias").distinct()
    safe = single.join(unsafe, "alias", "left_anti")
    named = safe.withColumn("m", F.count("*").over(Window.partitionBy("alias"))).select("k", F.when(F.col("m") > 1, F.concat(F.lit("merged-identity::"), "alias")).otherwise(F.col("alias")).alias("new"))
    return every.join(named, "k", "left").withColumn("merged", F.coalesce("new", "merged")).drop("new")


def eager(writes: DataFrame, jaccard: float = JACCARD, min_aliases: int = MIN_ALIASES) -> DataFrame:
    """seq, merged: the name that each write gets at its time, from what was written before it.

    Every write depends on all before it, of any source, so that one task goes through
    them in order, with the aliases of all keys in its memory; consensus over tables is merged().
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        aliases: dict[tuple, set] = {}
        having: dict[str, dict[tuple, None]] = {}
        named: dict[tuple, str] = {}
        out = []
        pdf = pdf.sort_values("seq")
        for source, label, name in pdf[["source_id", "label", "input"]].itertuples(index=False):
            key = (source, label)
            mine = aliases.setdefault(key, set())
            mine.add(name)
            having.setdefault(name, {})[key] = None
            if key not in named and len(mine) >= min_aliases:
                common: dict[tuple, int] = {}
                for a in mine:
                    for other in having[a]:
                        if other[0] != source and len(aliases[other]) >= min_aliases:
                            common[other] = common.get(other, 0) + 1
                best, near = None, 0.0
                for other in aliases:  # in order of first writes: the first of equals
                    if other in common and (score := common[other] / (len(mine) + len(aliases[other]) - common[other])) > near:
                        best, near = other, score
                if best is not None and near >= jaccard:
                    named[key] = named.setdefault(best, f"merged::{best[1]}")
            out.append(named.get(key, f"{source}::{label}"))
        return pd.DataFrame({"seq": pdf["seq"], "merged": out})

    return writes.select("seq", "source_id", "label", "input", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: run(pdf), "seq long, merged string")


class Normalizer:
    """Labels for writes (seq, source_id, input), which it remembers as tables; consolidate() merges labels across sources.

    Both go by what is new: a batch is clustered against the labels that there are, and
    a consolidation judges the pairs of keys that were written to since the last, and makes anew only the
    classes that such keys or pairs belong to. Writes come in the order of seq.
    """

    def __init__(self, spark, threshold: float = 0.7, rule: str = "all") -> None:
        self.spark, self.threshold, self.rule = spark, threshold, rule
        self.writes: DataFrame | None = None
        self.names: DataFrame | None = None
        self.edges: DataFrame | None = None
        self.known: DataFrame | None = None
        self.leaders: DataFrame | None = None
        self.done = -1
        self.since_last = 0
        self.last: dict | None = None
        #: Keys whose class the last consolidation made anew.
        self.renamed = 0

    def normalize(self, writes: DataFrame) -> DataFrame:
        """The writes with label, each by what its source wrote before, and name, the consolidated one where there is one."""
        from engramark.operators.clusters import leader_labels

        new = reliable(writes.select("seq", "source_id", "input"))
        if self.known is None:
            open_ = new
        else:
            open_ = new.join(self.known, ["source_id", "input"], "left_anti")
        found = reliable(leader_labels(open_, self.threshold, leaders=self.leaders))
        fresh = found.select("source_id", "input", "label").distinct()
        leaders = found.where("input = label").groupBy("source_id", "input").agg(F.min("seq").alias("seq"))
        self.known = reliable(fresh if self.known is None else self.known.unionByName(fresh))
        self.leaders = reliable(leaders if self.leaders is None else self.leaders.unionByName(leaders))
        x = reliable(new.join(self.known, ["source_id", "input"]))
        self.writes = x if self.writes is None else self.writes.unionByName(x)
        self.since_last += x.count()
        x = x.withColumn("own", F.concat_ws("::", "source_id", "label"))
        if self.names is None:
            return x.withColumn("name", F.col("own")).drop("own")
        return x.join(self.names.select("source_id", "label", "merged"), ["source_id", "label"], "left").withColumn("name", F.coalesce("merged", "own")).drop("own", "merged")

    def known_sources(self) -> list[str]:
        return [] if self.writes is None else [r[0] for r in self.writes.select("source_id").distinct().orderBy("source_id").collect()]

    def schedule_required(self, min_writes: int = 1) -> bool:
        """Whether that many writes came since the last consolidation."""
        return self.since_last >= min_writes

    def consolidate(self) -> dict:
        """Merges over all writes so far; how many keys and merged ones there are."""
        if self.writes is None:
            return {"keys": 0, "merged": 0}
        self.writes = reliable(self.writes)
        spread = F.array_sort(F.transform(_token_buckets(), lambda b: b))
        labels = self.writes.withColumn("vector", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.size(F.filter(spread, lambda b: b == i)).cast("double")))
        if self.names is None or self.rule != "all":
            self.edges = reliable(judged_pairs(labels, self.rule))
            self.names = reliable(merged(labels, self.edges))
            self.renamed = self.names.count()
        elif self.since_last:
            self._renew(labels)
        self.done = self.writes.agg(F.max("seq")).first()[0]
        self.since_last = 0
        self.last = self.names.agg(F.count("*").alias("keys"), F.count_if(F.startswith("merged", F.lit("merged::"))).alias("merged")).first().asDict()
        return self.last

    def _renew(self, labels: DataFrame) -> None:
        """Judges the pairs of touched keys anew, and names the classes that held a touched key, or that a new pair joins."""
        key = F.concat_ws("::", "source_id", "label").alias("k")
        touched = reliable(labels.where(F.col("seq") > self.done).select(key).distinct())
        fresh = reliable(judged_pairs(labels, self.rule, touched=touched))
        old = self.edges.join(touched.withColumnRenamed("k", "u"), "u", "left_anti").join(touched.withColumnRenamed("k", "v"), "v", "left_anti")
        self.edges = reliable(old.select(*fresh.columns).unionByName(fresh))
        ends = touched.union(fresh.select("u")).union(fresh.select("v")).distinct()
        classes = self.names.join(ends, "k", "left_semi").select("merged").distinct()
        # Classes of one name are made anew together: a name tells a label, not a class.
        affected = reliable(self.names.join(classes, "merged", "left_semi").select("k").union(ends).distinct())
        inside = self.edges.join(affected.withColumnRenamed("k", "u"), "u", "left_semi").join(affected.withColumnRenamed("k", "v"), "v", "left_semi")
        mine = labels.join(affected, key == affected["k"], "left_semi")
        again = merged(mine, inside)
        self.names = reliable(self.names.join(affected, "k", "left_anti").select(*again.columns).unionByName(again))
        self.renamed = affected.count()


def _token_buckets() -> Column:
    from engramark.functions import text

    return F.transform(text.tokens("input"), lambda t: text.token_bucket(t) % 256)


def cadenced(spark, writes: DataFrame, every: int) -> tuple[DataFrame, Normalizer]:
    """The writes in batches of ``every`` by seq, with a consolidation after each: each write's name at its time, and the normalizer."""
    normalizer = Normalizer(spark)
    top = writes.agg(F.max("seq")).first()[0]
    out = None
    for start in range(0, (top or -1) + 1, every):
        batch = normalizer.normalize(writes.where((F.col("seq") >= start) & (F.col("seq") < start + every))).select("seq", "name")
        batch = reliable(batch)
        out = batch if out is None else out.unionByName(batch)
        normalizer.consolidate()
    return out, normalizer
