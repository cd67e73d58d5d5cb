"""Order-dependent clustering in parallel rounds, equal to going through the inputs one by one.

One by one, each new input of a source takes the label of the nearest earlier leader,
the first of equals, if it is near enough and the two may merge, and else becomes a
leader. What an input becomes depends only on earlier inputs that are near it. So in
each round every input is settled for which no unsettled earlier input could become a
leader that beats the best it has: many at a time, of one source too.

Inputs of one vector are a class. Of its leaders only the first can ever be the
nearest, so that near pairs are looked for between classes, and a class with many inputs
isn't compared within itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators import dense, neighbours, sparse
from engramark.operators.graph import reliable

#: Cosines are compared to so many places.
PLACES = 12
#: What is still open is finished one by one in a task once it has at most so many inputs, and so many links of their classes.
LAST_INPUTS = 20_000
LAST_LINKS = 500_000


def bag(tokens: Column) -> Column:
    """The hashed token counts of an array of tokens: array of (i, w) by i, without zeros."""
    hashed = F.transform(tokens, lambda t: F.struct(text.token_bucket(t).alias("i"), text.token_sign(t).alias("s")))
    places = F.array_sort(F.array_distinct(F.transform(hashed, lambda h: h["i"])))
    sums = F.transform(places, lambda i: F.struct(i.alias("i"), F.aggregate(F.filter(hashed, lambda h: h["i"] == i), F.lit(0), lambda a, h: a + h["s"]).alias("w")))
    return F.filter(sums, lambda e: e["w"] != 0)


def classes(inputs: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """inputs (source_id, input, seq, and vector where it has a weight) with bag, class and own, the squared length of the joined vector before it is made 1."""
    vector = F.col("vector").cast("array<double>") if weights[1] > 0 else F.lit(None).cast("array<double>")
    usable = F.when(F.exists(vector, lambda e: e != 0), text.normalized(vector)) if weights[1] > 0 else vector
    x = inputs.withColumn("bag", bag(text.tokens("input")) if weights[0] > 0 else F.expr("cast(array() as array<struct<i: int, w: int>>)")).withColumn("v", usable)
    own = F.when(F.size("bag") > 0, weights[0] ** 2).otherwise(0.0) + F.when(F.col("v").isNotNull(), weights[1] ** 2).otherwise(0.0)
    return x.withColumn("own", own).withColumn("class", F.sha2(F.to_json(F.struct("source_id", "bag", "v")), 256))


def near_classes(kinds: DataFrame, threshold: float, weights: tuple[float, float], index: str, fresh: DataFrame | None = None) -> DataFrame:
    """(a, b, cosine), both ways: classes (source_id, class, bag, v, own) of one source with at least the threshold.

    The joined cosine is a weighted mean of the parts' cosines, so that one of the parts
    reaches the threshold, or the tokens a lower one if the vectors can't make up for it.
    ``index`` is exact, or graph, which takes the vectors' pairs from a graph index. With
    ``fresh`` (k) only pairs are looked for of which one class is fresh.
    """
    by_tokens, by_vector = weights[0] ** 2, weights[1] ** 2
    length = F.sqrt(F.aggregate("bag", F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
    bags = kinds.where(F.size("bag") > 0).select("source_id", F.col("class").alias("k"), length.alias("_n"), F.explode("bag").alias("e")).select("source_id", "k", F.col("e.i").alias("i"), (F.col("e.w") / F.col("_n")).alias("c"))
    bags = reliable(bags)
    vectors = dense.packed(kinds.where("v is not null").select(F.col("class").alias("id"), F.col("v").alias("vector"))) if by_vector else None
    enough = (threshold * (by_tokens + by_vector) - by_vector) / by_tokens if by_tokens else 0.0
    tokens_decide = by_tokens > 0 and enough > 0.2 and (by_vector / (by_tokens + by_vector)) ** 0.5 < threshold
    found = sparse.candidates(bags, enough if tokens_decide else threshold, ("source_id",), fresh).select("u", "v") if by_tokens else None
    if by_vector:
        # Where tokens decide, only classes without any are near by their vectors alone.
        some = vectors.join(kinds.where(F.size("bag") == 0).select(F.col("class").alias("id")), "id", "left_semi") if tokens_decide else vectors
        some = some.join(kinds.select(F.col("class").alias("id"), "source_id"), "id")
        met = _linked(some) if index == "graph" else dense.expanded(*dense.pairs(some, threshold, ("source_id",))[:2]).select("u", "v")
        found = met if found is None else found.union(met).distinct()
    one, two = (kinds.select("source_id", F.col("class").alias(end), F.col("bag").alias(f"bag_{end}"), F.col("v").alias(f"v_{end}"), F.col("own").alias(f"own_{end}")) for end in ("u", "v"))
    x = found.join(one.withColumnRenamed("v_u", "vector_u"), "u").join(two.withColumnRenamed("v_v", "vector_v"), ["source_id", "v"])

    def dot_of_bags() -> Column:
        size = lambda b: F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
        other = F.map_from_entries(F.col("bag_v"))
        shared = F.aggregate("bag_u", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(other[e["i"]], F.lit(0)))
        return F.when((F.size("bag_u") > 0) & (F.size("bag_v") > 0), shared / (size("bag_u") * size("bag_v"))).otherwise(0.0)

    dot_of_vectors = F.coalesce(F.aggregate(F.zip_with("vector_u", "vector_v", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e), F.lit(0.0))
    cosine = (by_tokens * dot_of_bags() + by_vector * dot_of_vectors) / F.sqrt(F.col("own_u") * F.col("own_v"))
    near = reliable(x.select("u", "v", F.round(cosine, PLACES).alias("cosine")).where(F.col("cosine") >= round(threshold, PLACES)))
    return near.select(F.col("u").alias("a"), F.col("v").alias("b"), "cosine").union(near.select(F.col("v").alias("a"), F.col("u").alias("b"), "cosine"))


def _linked(rows: DataFrame) -> DataFrame:
    """u < v of all links of a graph index over the vectors."""
    links = neighbours.graph(rows.select("id", "x")).select(F.col("id").alias("u"), F.explode("links").alias("v"))
    return links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def leader_labels(forms: DataFrame, threshold: float = 0.7, guarded: bool = True, weights: tuple[float, float] = (1.0, 0.0), index: str = "exact", leaders: DataFrame | None = None) -> DataFrame:
    """forms (seq, source_id, input, and vector where it has a weight) with label: the labels of going through each source's inputs by seq.

    Nearness is as in canonical.leader_clusters(). An input without tokens and vector is
    a label of its own. Of equal inputs the first counts. A round is a few joins; the rounds end
    when a bounded rest is open, so that a long chain of inputs each of which waits
    for the one before doesn't make as many rounds. ``leaders`` (the columns of forms) are
    labels that earlier inputs have become, all before the forms and none of them among them.
    """
    extra = [F.min_by("vector", "seq").alias("vector")] if weights[1] > 0 else []
    inputs = forms.groupBy("source_id", "input").agg(F.min("seq").alias("seq"), *extra).withColumn("led", F.lit(False))
    if leaders is not None:
        inputs = inputs.unionByName(leaders.select(*inputs.columns[:-1]).withColumn("led", F.lit(True)))
    placed = reliable(classes(inputs, weights).select("source_id", "input", "seq", "class", "bag", "v", "own", "led"))
    kinds = placed.groupBy("class").agg(F.first("source_id").alias("source_id"), F.first("bag").alias("bag"), F.first("v").alias("v"), F.first("own").alias("own"))
    fresh = None if leaders is None else placed.where("not led").select(F.col("class").alias("k")).distinct()
    near = near_classes(kinds.where("own > 0"), threshold, weights, index, fresh)
    itself = kinds.where("own > 0").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("cosine"))
    links = reliable(near.union(itself)) if threshold <= 1 else reliable(near)
    settled = placed.where("own = 0 and not led").select("source_id", "input", F.col("input").alias("label"))
    open_ = reliable(placed.where("own > 0 and not led").select("source_id", "input", "seq", "class"))
    leads = reliable(placed.where("own > 0 and led").groupBy("class").agg(F.min("seq").alias("lead"), F.min_by("input", "seq").alias("leader")))
    done = [settled]
    while (n := open_.count()) > LAST_INPUTS or (n and _links_of(open_, links).limit(LAST_LINKS + 1).count() > LAST_LINKS):
        fresh, open_, leads = _round(open_, leads, links, guarded)
        done.append(fresh)
    if n:
        done.append(_last(open_, leads, _links_of(open_, links), guarded))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return forms.join(out, ["source_id", "input"])


def _links_of(open_: DataFrame, links: DataFrame) -> DataFrame:
    return links.join(open_.select(F.col("class").alias("a")).distinct(), "a", "left_semi")


def _last(open_: DataFrame, leads: DataFrame, links: DataFrame, guarded: bool) -> DataFrame:
    """The labels of the inputs that are open, of which there are LAST_INPUTS at most, one after the other."""
    import pandas as pd

    trailing = set(text.TRAILING_WORDS)
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))
    members = open_.withColumn("words", text.words("input")).withColumn("digits", digits("input")).withColumn("one", F.lit(0))
    ends = links.join(leads.withColumnRenamed("class", "b"), "b", "left").withColumn("words", text.words("leader")).withColumn("digits", digits("leader")).withColumn("one", F.lit(0))

    def run(members: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        def may_merge(one: tuple, two: tuple) -> bool:
            x, y = sorted((one[1], two[1]), key=len)
            return one[2] == two[2] and not (len(y) == len(x) + 1 and y[:-1] == x and y[-1] in trailing)

        lead: dict[str, tuple] = {}
        near: dict[str, list] = {}
        for a, b, cosine, seq, leader, words, digit in ends[["a", "b", "cosine", "lead", "leader", "words", "digits"]].itertuples(index=False):
            near.setdefault(a, []).append((cosine, b))
            if leader is not None:
                lead[b] = (seq, list(words), list(digit), leader)
        out = []
        for kind, seq, name, words, digit in members.sort_values("seq")[["class", "seq", "input", "words", "digits"]].itertuples(index=False):
            own = (seq, list(words), list(digit), name)
            best = max(((cosine, -lead[b][0], b) for cosine, b in near.get(kind, ()) if b in lead and lead[b][0] < seq), default=None)
            if best and (not guarded or may_merge(own, lead[best[2]])):
                out.append(lead[best[2]][3])
            else:
                lead.setdefault(kind, own)
                out.append(name)
        x = members.sort_values("seq")
        return pd.DataFrame({"source_id": x["source_id"], "input": x["input"], "label": out})

    # Of one sequence per source only the order within it matters: sources share no links.
    return reliable(members.groupBy("one").cogroup(ends.groupBy("one")).applyInPandas(lambda a, b: run(a, b), "source_id string, input string, label string"))


def _round(open_: DataFrame, leads: DataFrame, links: DataFrame, guarded: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(newly settled, still open, the classes' first leaders)."""
    waiting = open_.groupBy("class").agg(F.min("seq").alias("horizon"))
    # A class without a leader may still get one from its first open input on.
    ends = links.join(leads.withColumnRenamed("class", "b"), "b", "left").join(waiting.withColumnRenamed("class", "b"), "b", "left")
    ends = ends.where(F.col("lead").isNotNull() | (F.col("horizon").isNotNull() & (F.col("a") != F.col("b"))))
    x = open_.join(ends, open_["class"] == ends["a"], "left")
    has, may = F.col("lead") < F.col("seq"), F.col("lead").isNull() & (F.col("horizon") < F.col("seq"))
    best = F.max(F.when(has, F.struct("cosine", (-F.col("lead")).alias("turn"), "leader")))
    seen = x.groupBy("source_id", "class", "seq", "input").agg(best.alias("best"), F.max(F.when(may, F.col("cosine"))).alias("threat"))
    seen = seen.withColumn("leader", F.col("best.leader"))
    unknown = F.col("threat").isNotNull() & (F.col("best").isNull() | (F.col("threat") >= F.col("best.cosine")))
    joins = F.col("best").isNotNull() & (text.merge_allowed("input", "leader") if guarded else F.lit(True))
    seen = reliable(seen.withColumn("state", F.when(unknown, "unknown").when(joins, "joins").otherwise("leads")))
    # In a class without a leader the first input that leads ends what can be told: those after it wait for the next round.
    turn = seen.groupBy("class").agg(F.min(F.when(F.col("state") == "unknown", F.col("seq"))).alias("unknown"), F.min(F.when(F.col("state") == "leads", F.col("seq"))).alias("leads"), F.min_by("input", F.when(F.col("state") == "leads", F.col("seq"))).alias("first"))
    y = seen.join(turn, "class").join(leads.select("class", F.lit(True).alias("led")), "class", "left")
    before = F.least(F.coalesce("unknown", F.lit((1 << 63) - 1)), F.coalesce(F.col("leads") + 1, F.lit((1 << 63) - 1)))
    told = F.when(F.col("led"), F.col("state") != "unknown").otherwise(F.col("seq") < before)
    y = reliable(y.select("source_id", "class", "seq", "input", told.alias("told"), F.when(F.col("state") == "joins", F.col("leader")).otherwise(F.col("input")).alias("label")))
    new = turn.where("leads is not null and (unknown is null or leads < unknown)").select("class", F.col("leads").alias("lead"), F.col("first").alias("leader"))
    leads = reliable(leads.union(new.join(leads, "class", "left_anti")))
    return y.where("told").select("source_id", "input", "label"), y.where("not told").select("source_id", "input", "seq", "class"), leads
