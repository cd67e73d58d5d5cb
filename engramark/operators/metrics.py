"""Clustering, retrieval and paired metrics, percentiles, resampling and sequential testing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators.graph import reliable

#: Tasks for each core that pairs are dealt to.
DEALT = 4


def per_item(labels: DataFrame, *by: str) -> DataFrame:
    """Adds B-cubed precision, recall, f1 and strict for rows of (by, label, oracle), from three partition counts."""
    cell, pred, true = (F.count("*").over(Window.partitionBy(*by, *c)) for c in (("label", "oracle"), ("label",), ("oracle",)))
    x = labels.withColumns({"n_cell": cell, "n_pred": pred, "n_true": true})
    x = x.withColumns({"precision": F.col("n_cell") / F.col("n_pred"), "recall": F.col("n_cell") / F.col("n_true")})
    x = x.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return x.withColumn("strict", (F.col("n_cell") == F.col("n_pred")) & (F.col("n_cell") == F.col("n_true")))


def pairwise(labels: DataFrame, *by: str) -> DataFrame:
    """Pairwise precision, recall and f1 by contingency counts, in one pass over grouping sets; 0 where there is no pair."""
    cells = labels.groupBy(*by, "label", "oracle").agg(F.count("*").alias("n"))

    def pairs(df: DataFrame, *keys: str) -> DataFrame:
        n = df.groupBy(*by, *keys).agg(F.sum("n").alias("n"))
        return n.groupBy(*by).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("_".join(("pairs", *keys))))

    x = pairs(cells, "label", "oracle").join(pairs(cells, "label"), [*by]).join(pairs(cells, "oracle"), [*by])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    x = x.withColumns({"pair_precision": ratio("pairs_label_oracle", "pairs_label"), "pair_recall": ratio("pairs_label_oracle", "pairs_oracle")})
    total = F.col("pair_precision") + F.col("pair_recall")
    return x.select(*by, "pair_precision", "pair_recall", F.when(total > 0, 2 * F.col("pair_precision") * F.col("pair_recall") / total).otherwise(0.0).alias("pair_f1"))


def percentile_floor(values: Column, q: float) -> Column:
    """The sorted value at int(q n), the last at most."""
    n = F.size(values)
    return F.element_at(values, (F.least(n - 1, F.floor(n * q)) + 1).cast("int"))


def percentile_round(values: Column, q: float) -> Column:
    """The sorted value at round(q n) - 1, rounded half to even, within bounds."""
    n = F.size(values)
    return F.element_at(values, (F.greatest(F.lit(0), F.least(n - 1, F.bround(n * q).cast("int") - 1)) + 1).cast("int"))


def cuped(df: DataFrame, value: str, base: str) -> DataFrame:
    """theta, rho, rho2 and the adjusted variance, in one aggregate; rho is 0 where either variance is."""
    x = df.agg(F.covar_samp(value, base).alias("c"), F.var_samp(value).alias("vv"), F.var_samp(base).alias("vb"), F.count("*").alias("n"))
    theta, rho = F.col("c") / F.col("vb"), F.when((F.col("vv") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("vv") * F.col("vb"))).otherwise(0.0)
    return x.select("n", theta.alias("theta"), rho.alias("rho"), (rho * rho).alias("rho2"), (F.col("vv") - theta * F.col("c")).alias("adjusted_variance"))


def paired_bootstrap(diffs: DataFrame, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Mean, percentile interval and p-values of paired differences (k from 0, diff), by draws that any engine repeats."""
    n = diffs.count()
    draws = diffs.sparkSession.range(resamples).withColumnRenamed("id", "rep")
    slots = draws.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    drawn = slots.withColumn("k", F.floor(text.uniform(seed, F.col("rep"), F.col("slot")) * n))
    means = drawn.join(diffs, "k").groupBy("rep").agg(F.avg("diff").alias("m"))
    x = means.agg(F.array_sort(F.collect_list("m")).alias("ms"), F.avg((F.col("m") <= 0).cast("double")).alias("p1"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    p2 = 2 * F.least(F.col("p1"), 1 - F.col("p1"))
    return x.crossJoin(diffs.agg(F.avg("diff").alias("mean"))).select("mean", F.element_at("ms", lo + 1).alias("lo"), F.element_at("ms", hi + 1).alias("hi"), "p1", p2.alias("p2"))


def outcome(lo: Column, hi: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when((lo > 0) & (p <= alpha), "SUPERIOR").when(hi < 0, "REGRESSION").when((lo <= 0) & (hi >= 0), "INCONCLUSIVE").otherwise("FAIL_TO_REJECT")


def ledger(tests: DataFrame, q: float = 0.10, ratio: float = 0.5) -> DataFrame:
    """n, p_value, alpha, rejected, wealth of an online false-discovery ledger over tests (n from 1, p_value).

    The order is the algorithm: one fold over the ordered tests of one ledger, in a single row.
    """
    w0 = q * ratio
    gamma = lambda n: text.discount(n.cast("double"))

    def step(s: Column, t: Column) -> Column:
        rewards = F.aggregate(F.transform(s["hits"], lambda h, j: gamma(t["n"] - h) * F.when(j == 0, q - w0).otherwise(q)), F.lit(0.0), lambda a, x: a + x)
        alpha = F.greatest(F.lit(0.0), F.least(F.lit(q), gamma(t["n"]) * w0 + rewards))
        hit = t["p_value"] <= alpha
        wealth = s["wealth"] - alpha + F.when(hit, q).otherwise(0.0)
        return F.struct(F.when(hit, F.concat(s["hits"], F.array(t["n"]))).otherwise(s["hits"]).alias("hits"), wealth.alias("wealth"), F.concat(s["rows"], F.array(F.struct(t["n"].alias("n"), t["p_value"].alias("p_value"), alpha.alias("alpha"), hit.alias("rejected"), wealth.alias("wealth")))).alias("rows"))

    start = F.struct(F.expr("cast(array() as array<bigint>)").alias("hits"), F.lit(w0).alias("wealth"), F.expr("cast(array() as array<struct<n: bigint, p_value: double, alpha: double, rejected: boolean, wealth: double>>)").alias("rows"))
    ordered = tests.agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("long").alias("n"), "p_value"))).alias("ts"))
    return ordered.select(F.inline(F.aggregate("ts", start, step)["rows"]))


def set_scores(found: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and f1 of two sets; nothing found is 0, nothing to find is 1."""
    hit = F.size(F.array_intersect(found, truth))
    p = F.when(F.size(found) == 0, 0.0).otherwise(hit / F.size(found))
    r = F.when(F.size(truth) == 0, 1.0).otherwise(hit / F.size(truth))
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def percentile_of_counts(counts: DataFrame, value: str, n: str, q: float, *by: str) -> DataFrame:
    """by, percentile: the sorted value at int(q N), the last at most, from how often each value occurs: no list of all values is made."""
    return percentiles_of_counts(counts, value, n, {"percentile": (q, False)}, *by)


def percentiles_of_counts(counts: DataFrame, value: str, n: str, asked: dict[str, tuple[float, bool]], *by: str) -> DataFrame:
    """by and a column for each name of ``asked``, (q, rounded): the sorted value at int(q N), or at round(q N) - 1 rounded half to even, within bounds; one pass over the different values."""
    up_to = F.sum(n).over(Window.partitionBy(*by).orderBy(value))
    total = F.sum(n).over(Window.partitionBy(*by))
    x = counts.groupBy(*by, value).agg(F.sum(n).alias(n)).withColumn("_up_to", up_to).withColumn("_total", total)

    def at(q: float, rounded: bool) -> Column:
        place = F.greatest(F.lit(0), F.bround(F.col("_total") * q) - 1) if rounded else F.floor(F.col("_total") * q)
        return F.least(F.col("_total") - 1, place)

    return x.groupBy(*by).agg(*(F.min(F.when(F.col("_up_to") > at(*a), F.col(value))).alias(name) for name, a in asked.items()))


def rate_interval(outcomes: DataFrame, done: str, resamples: int, seed: int, *by: str, alpha: float = 0.05) -> DataFrame:
    """by, rate, lo, hi: percentile interval of a success rate by resampling; a resample's successes are the draws below the rate, summed for each without making n x resamples rows at once in one task."""
    base = outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col(done).cast("double")).alias("rate"))
    slots = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    hit = text.uniform(seed, F.col("rep"), F.col("slot")) < F.col("rate")
    means = slots.groupBy(*by, "rep").agg(F.avg(hit.cast("double")).alias("m"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    ends = means.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return base.join(ends, [*by]).select(*by, "rate", F.element_at("ms", lo + 1).alias("lo"), F.element_at("ms", max(lo, hi) + 1).alias("hi"))


def metric_bootstrap(items: DataFrame, metric: Column, resamples: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """lo, hi of a metric, an aggregate of items (k from 0, ...), over resamples of whole items. Not for metrics of pairs, as a resample repeats items."""
    n = items.count()
    slots = items.sparkSession.range(resamples).withColumnRenamed("id", "rep").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    drawn = slots.withColumn("k", F.floor(text.uniform(seed, F.col("rep"), F.col("slot")) * n))
    x = drawn.join(items, "k").groupBy("rep").agg(metric.alias("m")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    return x.select(F.element_at("ms", lo + 1).alias("lo"), F.element_at("ms", max(lo, hi) + 1).alias("hi"))


def either_empty(found: Column, truth: Column) -> dict[str, Column]:
    """Precision, recall and f1 of sets: 1 where both are empty, 0 where one is."""
    hit, a, b = F.size(F.array_intersect(found, truth)), F.size(found), F.size(truth)
    both, none = (a == 0) & (b == 0), (a == 0) | (b == 0)
    ratio = lambda n: F.when(both, 1.0).when(none, 0.0).otherwise(hit / n)
    p, r = ratio(a), ratio(b)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def top_k_retrieval(rows: DataFrame, k: int) -> DataFrame:
    """canonical, precision, recall, f1 of rows (canonical, rank from 1, relevant): the first k answers of each against all relevant ones."""
    x = rows.groupBy("canonical").agg(F.count_if((F.col("rank") <= k) & F.col("relevant")).alias("hit"), F.count_if(F.col("rank") <= k).alias("found"), F.count_if("relevant").alias("truth"))
    p, r = (F.when(F.col(c) > 0, F.col("hit") / F.col(c)).otherwise(0.0) for c in ("found", "truth"))
    return x.select("canonical", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def reduction(labels: DataFrame, *by: str) -> DataFrame:
    """by, n, accuracy, forms, labels, reduction_pct: how often the label is the oracle, and how many forms became how many labels."""
    forms, kinds = F.countDistinct("input"), F.countDistinct("label")
    return labels.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("oracle")).cast("double")).alias("accuracy"), forms.alias("forms"), kinds.alias("labels"), (100.0 * (forms - kinds) / forms).alias("reduction_pct"))


def adjusted_rand(labels: DataFrame, *by: str) -> DataFrame:
    """by, ari: agreement of label and oracle beyond chance, from contingency counts; 1 where both are all apart or all together."""
    cells = labels.groupBy(*by, "label", "oracle").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    cell = cells.groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias("both"), pairs(F.sum("n")).alias("every"))
    for c in ("label", "oracle"):
        one = cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs(F.col("n"))).alias(f"of_{c}"))
        cell = cell.join(one, [*by]) if by else cell.crossJoin(one)
    expected = F.when(F.col("every") > 0, F.col("of_label") * F.col("of_oracle") / F.col("every")).otherwise(0.0)
    most = (F.col("of_label") + F.col("of_oracle")) / 2
    return cell.select(*by, F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"))


def overlap_with_first(ranked: DataFrame, top: int = 10) -> DataFrame:
    """How many of the ``top`` rows by rate (rate, lo, hi) have an interval that meets that of the first."""
    best = ranked.orderBy(F.desc("rate"), *(c for c in ranked.columns if c not in ("rate", "lo", "hi"))).limit(top)
    first = best.agg(F.max_by("lo", "rate").alias("f_lo"), F.max_by("hi", "rate").alias("f_hi"))
    return best.crossJoin(F.broadcast(first)).agg(F.count_if((F.col("hi") >= F.col("f_lo")) & (F.col("lo") <= F.col("f_hi"))).alias("overlapping"), F.count("*").alias("n"))


def separation(scores: DataFrame) -> DataFrame:
    """positive_median, negative_median and overlap of scores (score, positive): the share of pairs whose negative is at least the positive, from ranks, not from pairs."""
    order = Window.orderBy("score")
    below = F.sum(F.when(F.col("positive"), F.col("c")).otherwise(0)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    counts = scores.groupBy("score", "positive").agg(F.count("*").alias("c")).withColumn("below", below)
    x = counts.agg(F.sum(F.when(~F.col("positive"), F.col("c") * F.col("below"))).alias("hits"), F.sum(F.when(F.col("positive"), F.col("c"))).alias("np"), F.sum(F.when(~F.col("positive"), F.col("c"))).alias("nn"))
    m = scores.agg(F.median(F.when(F.col("positive"), F.col("score"))).alias("positive_median"), F.median(F.when(~F.col("positive"), F.col("score"))).alias("negative_median"))
    return m.crossJoin(x).select("positive_median", "negative_median", (F.col("hits") / (F.col("np") * F.col("nn"))).alias("overlap"))


#: Writes at the start that aren't measured: so many at most, and this part of all.
WARM_UP, WARM_UP_PART = 50, 20


def throughput(writes: DataFrame, order: str, ms: str, *by: str) -> DataFrame:
    """by, warmed, measured, per_second, p50 and p99 of the times ``ms`` of writes, without the first ones by ``order``, which warm up.

    Only those are ranked; the others are counted by their times. The rate is that of the measured writes over the seconds that they took.
    """
    n = writes.groupBy(*by).agg(F.count("*").alias("_n"))
    first = writes.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= WARM_UP)
    warm = first.join(n, [*by]).where(F.col("_r") <= F.floor(F.col("_n") / WARM_UP_PART))
    counts = writes.groupBy(*by, ms).agg(F.count("*").alias("n")).unionByName(warm.groupBy(*by, ms).agg((-F.count("*")).alias("n")))
    left = counts.groupBy(*by, ms).agg(F.sum("n").alias("n")).where("n > 0")
    sums = left.groupBy(*by).agg(F.sum("n").alias("measured"), (F.sum(F.col("n") * F.col(ms)) / 1000).alias("_s"))
    out = percentiles_of_counts(left, ms, "n", {"p50": (0.5, False), "p99": (0.99, False)}, *by).join(sums, [*by]).join(n, [*by])
    rate = F.when(F.col("_s") > 0, F.col("measured") / F.col("_s")).otherwise(0.0)
    return out.select(*by, (F.col("_n") - F.col("measured")).alias("warmed"), "measured", rate.alias("per_second"), "p50", "p99")


def merged_alone(pairs: DataFrame, threshold: float, guarded: bool = True) -> DataFrame:
    """pairs (a, b, ...) with merged: whether a clustering that has seen nothing else puts the two names under one label, by the cosine of their hashed tokens."""
    def hashed(name: str) -> Column:
        return F.transform(text.tokens(name), lambda t: F.struct(text.token_bucket(t).alias("i"), text.token_sign(t).alias("s")))

    def bag(tokens: str) -> Column:
        each = F.array_distinct(F.transform(tokens, lambda h: h["i"]))
        return F.transform(each, lambda i: F.struct(i.alias("i"), F.aggregate(F.filter(tokens, lambda h: h["i"] == i), F.lit(0), lambda s, h: s + h["s"]).alias("w")))

    # A pair costs far more than its bytes tell, so that a small file is dealt to all cores. Tokens and maps are columns of their own, made once a row.
    x = pairs.repartition(DEALT * pairs.sparkSession.sparkContext.defaultParallelism)
    x = x.withColumn("_ha", hashed("a")).withColumn("_hb", hashed("b")).withColumn("_a", bag("_ha")).withColumn("_b", bag("_hb")).withColumn("_m", F.map_from_entries("_b"))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + e["w"] * e["w"])
    dot = F.aggregate("_a", F.lit(0.0), lambda s, e: s + e["w"] * F.coalesce(F.col("_m")[e["i"]], F.lit(0)))
    norm = F.sqrt(size("_a") * size("_b"))
    near = F.coalesce(dot / F.when(norm > 0, norm) >= threshold - 1e-12, F.lit(False))
    near = near & text.merge_allowed("a", "b") if guarded else near
    return x.withColumn("merged", near | (F.col("a") == F.col("b"))).drop("_ha", "_hb", "_a", "_b", "_m")


def with_examples(rows: DataFrame, order: str, flag: str, shown: tuple[str, str], most: int) -> DataFrame:
    """n, ``flag`` (how many have it), rate_pct, and examples: the first ``most`` of those, by ``order``, joined into a text."""
    # Flags are read twice and may be dear: they are made once.
    rows = reliable(rows.select(order, flag, *shown))
    first = rows.where(flag).orderBy(order).limit(most).agg(F.array_sort(F.collect_list(F.struct(order, F.concat(shown[0], F.lit(" = "), shown[1]).alias("x")))).alias("e"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col(flag)).alias(flag), F.round(100.0 * F.avg(F.col(flag).cast("double")), 4).alias("rate_pct"))
    return counts.crossJoin(first).select("n", flag, "rate_pct", F.array_join(F.transform("e", lambda e: e["x"]), "; ").alias("examples"))


def adjusted(df: DataFrame, value: str, base: str) -> DataFrame:
    """df with adjusted, the value less theta times what its base is above the mean: the values that cuped() reduces the variance of."""
    m = df.agg(F.covar_samp(value, base).alias("_c"), F.var_samp(base).alias("_v"), F.avg(base).alias("_m"))
    x = df.crossJoin(F.broadcast(m))
    theta = F.when(F.col("_v") > 0, F.col("_c") / F.col("_v")).otherwise(0.0)
    return x.withColumn("adjusted", F.col(value) - theta * (F.col(base) - F.col("_m"))).drop("_c", "_v", "_m")


def false_merges(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n, merged, rate_pct over pairs that should stay apart: how many got one label."""
    same = F.col(a) == F.col(b)
    return pairs.agg(F.count("*").alias("n"), F.count_if(same).alias("merged"), F.round(100.0 * F.avg(same.cast("double")), 4).alias("rate_pct"))


def proxy_ladder(outputs: DataFrame, resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """What a proxy changes for each model, of rows (model, k from 0, proxy, output, right, canonical): every item once without and once with it.

    model, n, accuracy, canonical rate and distinct outputs of both, differences, and
    lo, hi and p1 of the accuracy's from resamples of items, the same for all models.
    """
    with_, without = F.col("proxy"), ~F.col("proxy")
    rate = lambda on, c: F.avg(F.when(on, F.col(c).cast("double")))
    rates = {f"{name}_{side}": rate(on, c) for name, c in (("accuracy", "right"), ("canonical", "canonical")) for side, on in (("off", without), ("on", with_))}
    unique = {f"unique_{side}": F.countDistinct(F.when(on, F.col("output"))) for side, on in (("off", without), ("on", with_))}
    base = outputs.groupBy("model").agg(F.countDistinct("k").alias("n"), *(c.alias(n) for n, c in (rates | unique).items()))
    diffs = outputs.groupBy("model", "k").agg(F.sum(F.col("right").cast("int") * F.when(with_, 1).otherwise(-1)).alias("diff"))
    slots = base.select("model", "n").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    drawn = slots.withColumn("k", F.floor(text.uniform(seed, F.col("rep"), F.col("slot")) * F.col("n"))).join(diffs, ["model", "k"])
    means = drawn.groupBy("model", "rep").agg(F.avg("diff").alias("m")).groupBy("model").agg(F.array_sort(F.collect_list("m")).alias("ms"), F.avg((F.col("m") <= 0).cast("double")).alias("p1"))
    lo, hi = int(alpha / 2 * resamples), int((1 - alpha / 2) * resamples) - 1
    changes = [(F.col(f"{name}_on") - F.col(f"{name}_off")).alias(f"{name}_diff") for name in ("accuracy", "canonical")]
    return base.join(means, "model").select("model", "n", *rates, *changes, *unique, F.element_at("ms", lo + 1).alias("lo"), F.element_at("ms", max(lo, hi) + 1).alias("hi"), "p1")
