"""Queries of canonicalization and its metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators import canonical, dense, metrics
from engramark.sinks import artifacts
from engramark.sources.workloads import STUB_SQL, SURFACE_SQL, TOKENS_SQL, surface_forms, table


def tokens(spark: SparkSession, d: str) -> DataFrame:
    x = surface_forms(spark, d)
    return x.select("seq", F.array_join(text.tokens("input"), " ").alias("tokens"), text.stub_bucket("input").alias("stub"))


def token_buckets(spark: SparkSession, d: str) -> DataFrame:
    x = surface_forms(spark, d).select(F.explode(text.tokens("input")).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("n")).withColumn("bucket", text.token_bucket("token"))


def guard_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    other = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" of"))).when(F.col("p_size") % 3 == 1, F.concat_ws(" ", "p_name", F.col("p_size").cast("string"))).otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    x = p.select("p_partkey", F.col("p_name").alias("a"), other.alias("b"))
    return x.select("p_partkey", text.digits_differ("a", "b").alias("digits_differ"), text.trailing_word_differs("a", "b").alias("trailing_differs"), text.merge_allowed("a", "b").alias("may_merge"))


def _variants(spark: SparkSession, d: str) -> DataFrame:
    forms = surface_forms(spark, d)
    each = {"identity": canonical.identity(forms), "stub": canonical.stub(forms), "tokens": canonical.first_writer(forms), "per_source": canonical.first_writer(forms, "source_id")}
    per_source = each["per_source"].withColumn("label", F.concat_ws("::", "source_id", "label"))
    rows = [x.select(F.lit(k).alias("variant"), "seq", "label", "oracle") for k, x in (each | {"per_source": per_source}).items()]
    return reduce(DataFrame.unionByName, rows)


_VARIANTS_SQL = f"""{SURFACE_SQL},
keyed AS (SELECT *, array_to_string(list_sort({TOKENS_SQL}), ' ') AS tk FROM surface),
labelled AS (
  SELECT 'identity' AS variant, seq, input AS label, oracle FROM keyed
  UNION ALL SELECT 'stub', seq, {STUB_SQL}, oracle FROM keyed
  UNION ALL SELECT 'tokens', seq, first_value(input) OVER (PARTITION BY tk ORDER BY seq), oracle FROM keyed
  UNION ALL SELECT 'per_source', seq, source_id || '::' || first_value(input) OVER (PARTITION BY source_id, tk ORDER BY seq), oracle FROM keyed)"""


def canonical_quality(spark: SparkSession, d: str) -> DataFrame:
    """Pairwise, B-cubed and strict quality of each labelling variant."""
    labels = _variants(spark, d)
    items = metrics.per_item(labels, "variant").groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("precision"), 6).alias("bcubed_precision"), F.round(F.avg("recall"), 6).alias("bcubed_recall"), F.round(F.avg("f1"), 6).alias("bcubed_f1"), F.round(F.avg(F.col("strict").cast("double")), 6).alias("strict"))
    pairs = metrics.pairwise(labels, "variant")
    return items.join(pairs.select("variant", *(F.round(c, 6).alias(c) for c in ("pair_precision", "pair_recall", "pair_f1"))), "variant")


_CELLS_SQL = """cells AS (
  SELECT *, count(*) OVER (PARTITION BY variant, label, oracle) AS nc, count(*) OVER (PARTITION BY variant, label) AS np, count(*) OVER (PARTITION BY variant, oracle) AS nt FROM labelled)"""


def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Discordant counts of strict correctness between each variant and identity."""
    x = metrics.per_item(_variants(spark, d), "variant").select("variant", "seq", "strict")
    base = x.where("variant = 'identity'").select("seq", F.col("strict").alias("base"))
    both = x.where("variant <> 'identity'").join(base, "seq")
    return both.groupBy("variant").agg(F.count_if(F.col("strict") & ~F.col("base")).alias("only_variant"), F.count_if(~F.col("strict") & F.col("base")).alias("only_base"))


def leader(spark: SparkSession, d: str) -> DataFrame:
    return canonical.leader_clusters(surface_forms(spark, d)).select("seq", "source_id", "label")


def consolidation(spark: SparkSession, d: str) -> DataFrame:
    labels = canonical.first_writer(surface_forms(spark, d), "source_id")
    return canonical.consolidated(labels, min_overlap=2)


def drift(spark: SparkSession, d: str) -> DataFrame:
    """Share of labels that consolidation changes, by source."""
    labels = canonical.first_writer(surface_forms(spark, d), "source_id")
    merged = canonical.consolidated(labels, min_overlap=2)
    both = labels.join(merged, ["source_id", "label"])
    return both.groupBy("source_id").agg(F.round(F.avg((F.col("merged") != F.concat_ws("::", "source_id", "label")).cast("double")), 6).alias("drift"))


_CLUSTERS_SQL = f"""{SURFACE_SQL},
keyed AS (SELECT *, array_to_string(list_sort({TOKENS_SQL}), ' ') AS tk FROM surface),
local AS (SELECT source_id, input, first_value(input) OVER (PARTITION BY source_id, tk ORDER BY seq) AS label FROM keyed),
al AS (SELECT DISTINCT source_id || '::' || label AS k, source_id, lower(input) AS a FROM local),
sz AS (SELECT k, count(*) AS n FROM al GROUP BY k HAVING count(*) >= 2),
pr AS (
  SELECT x.k AS u, y.k AS v, count(*) AS c, any_value(p.n) AS na, any_value(q.n) AS nb
  FROM al x JOIN sz p ON p.k = x.k JOIN al y ON y.a = x.a AND x.k < y.k AND x.source_id <> y.source_id JOIN sz q ON q.k = y.k GROUP BY 1, 2),
e AS (SELECT u, v FROM pr WHERE c >= 2 AND c >= 0.5 * (na + nb - c)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM reach r JOIN b ON b.u = r.seen),
root AS (SELECT node, min(seen) AS merged FROM reach GROUP BY node),
final AS (SELECT DISTINCT l.source_id, l.label, coalesce(root.merged, l.source_id || '::' || l.label) AS merged FROM local l LEFT JOIN root ON root.node = l.source_id || '::' || l.label)"""


def noise(spark: SparkSession, d: str) -> DataFrame:
    return canonical.noise(surface_forms(spark, d), 0.2).select("seq", "noisy_input", "noisy_source")


def scale_up(spark: SparkSession, d: str) -> DataFrame:
    x = canonical.replicated(surface_forms(spark, d), 3)
    return x.groupBy("copy").agg(F.count("*").alias("n"), F.countDistinct("oracle").alias("oracles"), F.min("input").alias("least"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on held-out rows: whether the label learned from the others is one of the oracle's."""
    x = canonical.first_writer(canonical.held_out(surface_forms(spark, d), 0.2))
    known = x.where("not held").select("oracle", "label").distinct().withColumn("hit", F.lit(True))
    y = x.where("held").join(known, ["oracle", "label"], "left")
    return y.groupBy("oracle").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("hit", F.lit(False)).cast("double")), 6).alias("accuracy"))


def collisions(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of brands that use one normalized name for different types, counted without making the pairs of rows."""
    p = table(spark, d, "part").groupBy(F.lower(F.trim("p_name")).alias("name"), "p_brand", "p_type").agg(F.count("*").alias("n"))
    a, b = p.alias("a"), p.alias("b")
    on = (F.col("a.name") == F.col("b.name")) & (F.col("a.p_brand") < F.col("b.p_brand")) & (F.col("a.p_type") != F.col("b.p_type"))
    return a.join(b, on).groupBy(F.col("a.p_brand").alias("brand_a"), F.col("b.p_brand").alias("brand_b")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("pairs"))


def nearest(spark: SparkSession, d: str) -> DataFrame:
    """The most similar other vector of every hundredth one, a stated query set against all rows, in blocks of queries."""
    rows = dense.packed(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    x = dense.nearest(rows.where("id % 100 = 0"), rows)
    return x.select(F.col("query").alias("query_id"), F.col("id").alias("nearest"), F.col("cosine"))


def centroids(spark: SparkSession, d: str) -> DataFrame:
    """Normalized mean vector of each label, one row per dimension."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    norm = m.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return m.join(norm, "label").select("label", "i", F.round(F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(F.col("m")), 6).alias("c"))


def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each source's rows in order."""
    return artifacts.ordered_sha256(surface_forms(spark, d), "seq", F.concat("input", F.lit("\x1f"), "oracle", F.lit("\x1e")), "source_id")


def cuped(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return metrics.cuped(x, "o_totalprice", "c_acctbal").select("n", *(F.round(c, 4).alias(c) for c in ("theta", "rho", "rho2"))).withColumn("n", F.col("n"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the values of each event type by both conventions, from how often each value occurs."""
    counts = table(spark, d, "events").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    asked = {"p50_floor": (0.5, False), "p99_floor": (0.99, False), "p50_round": (0.5, True), "p95_round": (0.95, True), "p999_round": (0.999, True)}
    return metrics.percentiles_of_counts(counts, "value", "n", asked, "event_type")


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Interval and outcome of the difference of mean balances, customers less suppliers, by nation."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("c"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("s"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    diffs = n.join(c, "k", "left").join(s, "k", "left").select("k", (F.coalesce("c", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("diff"))
    x = metrics.paired_bootstrap(diffs, 400, 12648430)
    return x.select(*(F.round(c, 4).alias(c) for c in ("mean", "lo", "hi", "p1", "p2")), metrics.outcome(F.col("lo"), F.col("hi"), F.col("p2")).alias("outcome"))


def online_tests(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("n"), F.pow(text.uniform("p", F.col("n_nationkey")), F.lit(6)).alias("p_value"))
    x = metrics.ledger(p)
    return x.select("n", F.round("alpha", 8).alias("alpha"), "rejected", F.round("wealth", 8).alias("wealth"))


def retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Set scores of each order's open parts against its unreturned ones, averaged by priority."""
    item = table(spark, d, "lineitem")
    empty = F.expr("cast(array() as array<bigint>)")
    x = item.groupBy("l_orderkey").agg(F.coalesce(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))), empty).alias("found"), F.coalesce(F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_partkey"))), empty).alias("truth"))
    y = x.select("l_orderkey", *(c.alias(k) for k, c in metrics.set_scores(F.col("found"), F.col("truth")).items())).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return y.groupBy("o_orderpriority").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")), F.round(100 * F.avg((F.col("f1") >= 1).cast("double")), 4).alias("perfect_pct"))


QUERIES = {f.__name__: f for f in (tokens, token_buckets, guard_pairs, canonical_quality, mcnemar, leader, consolidation, drift, noise, scale_up, held_out, collisions, nearest, centroids, fingerprint, cuped, percentiles, bootstrap, online_tests, retrieval)}

_U = "CAST(('0x' || substr(sha256({}), 1, 8)) AS UBIGINT) / 4294967296.0"
_WORDS = r"string_split(trim(regexp_replace(lower(translate({}, '_-', '  ')), '\s+', ' ', 'g')), ' ')"

SQL = {
    "tokens": f"WITH {SURFACE_SQL} SELECT seq, array_to_string({TOKENS_SQL}, ' ') AS tokens, {STUB_SQL} AS stub FROM surface",
    "token_buckets": f"WITH {SURFACE_SQL}, t AS (SELECT unnest({TOKENS_SQL}) AS token FROM surface) SELECT token, count(*) AS n, CAST(('0x' || right(sha256(token), 3)) AS INT) AS bucket FROM t GROUP BY token",
    "guard_pairs": rf"""
WITH x AS (SELECT p_partkey, p_name AS a, CASE p_size % 3 WHEN 0 THEN p_name || ' of' WHEN 1 THEN p_name || ' ' || p_size ELSE replace(p_name, ' ', '_') END AS b FROM part),
y AS (SELECT *, regexp_extract_all(a, '\d+') <> regexp_extract_all(b, '\d+') AS dd, {_WORDS.format('a')} AS wa, {_WORDS.format('b')} AS wb FROM x),
z AS (SELECT *, abs(len(wa) - len(wb)) = 1 AND wa[1:least(len(wa), len(wb))] = wb[1:least(len(wa), len(wb))]
  AND (CASE WHEN len(wa) > len(wb) THEN wa[-1] ELSE wb[-1] END) IN ('by','of','for','to','in','on','at','with','from','as','into','over','under','about','through','via') AS td FROM y)
SELECT p_partkey, dd AS digits_differ, td AS trailing_differs, NOT (dd OR td) AS may_merge FROM z""",
    "canonical_quality": f"""
WITH {_VARIANTS_SQL}, {_CELLS_SQL},
pp AS (SELECT variant, sum(n * (n - 1) / 2) AS v FROM (SELECT variant, label, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY variant),
pt AS (SELECT variant, sum(n * (n - 1) / 2) AS v FROM (SELECT variant, oracle, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY variant),
pc AS (SELECT variant, sum(n * (n - 1) / 2) AS v FROM (SELECT variant, label, oracle, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY variant),
pr AS (SELECT pp.variant, CASE WHEN pp.v > 0 THEN pc.v / pp.v ELSE 0 END AS p, CASE WHEN pt.v > 0 THEN pc.v / pt.v ELSE 0 END AS r FROM pp JOIN pt USING (variant) JOIN pc USING (variant))
SELECT c.variant, count(*) AS n, round(avg(nc / np), 6) AS bcubed_precision, round(avg(nc / nt), 6) AS bcubed_recall, round(avg(2 * (nc / np) * (nc / nt) / (nc / np + nc / nt)), 6) AS bcubed_f1,
  round(avg(CASE WHEN nc = np AND nc = nt THEN 1.0 ELSE 0.0 END), 6) AS strict, round(any_value(p), 6) AS pair_precision, round(any_value(r), 6) AS pair_recall, round(any_value(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS pair_f1
FROM cells c JOIN pr ON pr.variant = c.variant GROUP BY c.variant""",
    "mcnemar": f"""
WITH {_VARIANTS_SQL}, {_CELLS_SQL}, s AS (SELECT variant, seq, nc = np AND nc = nt AS ok FROM cells)
SELECT a.variant, count(*) FILTER (a.ok AND NOT b.ok) AS only_variant, count(*) FILTER (b.ok AND NOT a.ok) AS only_base FROM s a JOIN s b ON a.seq = b.seq AND b.variant = 'identity' WHERE a.variant <> 'identity' GROUP BY a.variant""",
    "leader": f"WITH {SURFACE_SQL}, k AS (SELECT *, array_to_string(list_sort({TOKENS_SQL}), ' ') AS tk FROM surface) SELECT seq, source_id, first_value(input) OVER (PARTITION BY source_id, tk ORDER BY seq) AS label FROM k",
    "consolidation": f"WITH RECURSIVE {_CLUSTERS_SQL} SELECT source_id, label, merged FROM final",
    "drift": f"WITH RECURSIVE {_CLUSTERS_SQL} SELECT l.source_id, round(avg(CASE WHEN f.merged <> l.source_id || '::' || l.label THEN 1.0 ELSE 0.0 END), 6) AS drift FROM local l JOIN final f ON f.source_id = l.source_id AND f.label = l.label GROUP BY l.source_id",
    "noise": f"""
WITH {SURFACE_SQL}, u AS (SELECT *, {_U.format("'7:' || seq")} AS d, {_U.format("'8:' || seq")} AS m FROM surface)
SELECT seq, CASE WHEN NOT hit OR m < 1.0 / 3 THEN input WHEN m < 2.0 / 3 THEN upper(input) ELSE left(input, greatest(1, length(input) - 1)) END AS noisy_input,
  CASE WHEN hit AND m < 1.0 / 3 THEN source_id || '-swapped' ELSE source_id END AS noisy_source
FROM (SELECT *, row_number() OVER (ORDER BY d, seq) <= round_even(count(*) OVER () * 0.2, 0) AS hit FROM u)""",
    "scale_up": f"""
WITH {SURFACE_SQL}, c AS (SELECT range AS copy, CASE WHEN range = 0 THEN '' ELSE '_v' || (range - 1) END AS s FROM range(4))
SELECT copy, count(*) AS n, count(DISTINCT oracle || s) AS oracles, min(input || s) AS least FROM surface, c GROUP BY copy""",
    "held_out": f"""
WITH {SURFACE_SQL}, k AS (SELECT *, first_value(input) OVER (PARTITION BY array_to_string(list_sort({TOKENS_SQL}), ' ') ORDER BY seq) AS label,
  count(*) OVER (PARTITION BY oracle) AS n, row_number() OVER (PARTITION BY oracle ORDER BY {_U.format("'11:' || seq")}, seq) AS r FROM surface),
h AS (SELECT *, n > 1 AND r <= greatest(1, round_even(n * 0.2, 0)) AS held FROM k),
known AS (SELECT DISTINCT oracle, label FROM h WHERE NOT held)
SELECT h.oracle, count(*) AS n, round(avg(CASE WHEN known.label IS NULL THEN 0.0 ELSE 1.0 END), 6) AS accuracy FROM h LEFT JOIN known ON known.oracle = h.oracle AND known.label = h.label WHERE held GROUP BY h.oracle""",
    "collisions": "SELECT a.p_brand AS brand_a, b.p_brand AS brand_b, count(*) AS pairs FROM part a JOIN part b ON lower(trim(a.p_name)) = lower(trim(b.p_name)) AND a.p_brand < b.p_brand AND a.p_type <> b.p_type GROUP BY 1, 2",
    "nearest": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS c FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, vec_id AS nearest, c AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS r FROM p) WHERE r = 1""",
    "centroids": """
WITH x AS (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY ALL)
SELECT label, CAST(i AS INT) AS i, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS c FROM m""",
    "fingerprint": f"WITH {SURFACE_SQL} SELECT source_id, sha256(string_agg(input || chr(31) || oracle || chr(30), '' ORDER BY seq)) AS sha256 FROM surface GROUP BY source_id",
    "cuped": """
SELECT count(*) AS n, round(covar_samp(o_totalprice, c_acctbal) / var_samp(c_acctbal), 4) AS theta, round(corr(o_totalprice, c_acctbal), 4) AS rho, round(corr(o_totalprice, c_acctbal) ^ 2, 4) AS rho2
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "percentiles": """
WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, v[CAST(least(n - 1, floor(n * 0.5)) AS BIGINT) + 1] AS p50_floor, v[CAST(least(n - 1, floor(n * 0.99)) AS BIGINT) + 1] AS p99_floor,
  v[CAST(greatest(0, least(n - 1, round_even(n * 0.5, 0) - 1)) AS BIGINT) + 1] AS p50_round, v[CAST(greatest(0, least(n - 1, round_even(n * 0.95, 0) - 1)) AS BIGINT) + 1] AS p95_round, v[CAST(greatest(0, least(n - 1, round_even(n * 0.999, 0) - 1)) AS BIGINT) + 1] AS p999_round FROM v""",
    "bootstrap": f"""
WITH c AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, avg(s_acctbal) AS v FROM supplier GROUP BY 1),
d AS (SELECT n_nationkey AS k, coalesce(c.v, 0) - coalesce(s.v, 0) AS diff FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN s ON s.k = n_nationkey),
n AS (SELECT count(*) AS n FROM d),
w AS (SELECT r.range AS rep, floor({_U.format("'12648430:' || r.range || ':' || t.range")} * n.n) AS k FROM n, range(400) r, range((SELECT count(*) FROM d)) t),
m AS (SELECT rep, avg(diff) AS m FROM w JOIN d ON d.k = w.k GROUP BY rep),
a AS (SELECT list_sort(list(m)) AS ms, avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END) AS p1 FROM m),
o AS (SELECT (SELECT avg(diff) FROM d) AS mean, ms[11] AS lo, ms[390] AS hi, p1, 2 * least(p1, 1 - p1) AS p2 FROM a)
SELECT round(mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi, round(p1, 4) AS p1, round(p2, 4) AS p2,
  CASE WHEN lo > 0 AND p2 <= 0.05 THEN 'SUPERIOR' WHEN hi < 0 THEN 'REGRESSION' WHEN lo <= 0 AND hi >= 0 THEN 'INCONCLUSIVE' ELSE 'FAIL_TO_REJECT' END AS outcome FROM o""",
    "online_tests": f"""
WITH RECURSIVE t AS (SELECT n_nationkey + 1 AS n, ({_U.format("'p:' || n_nationkey")}) ^ 6 AS p FROM nation),
r AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS hits, CAST(0.05 AS DOUBLE) AS wealth, CAST(0 AS DOUBLE) AS alpha, false AS rejected
  UNION ALL
  SELECT n, CASE WHEN p <= a THEN list_append(hits, n) ELSE hits END, wealth - a + CASE WHEN p <= a THEN 0.1 ELSE 0 END, a, p <= a
  FROM (SELECT CAST(t.n AS BIGINT) AS n, t.p, r.hits, r.wealth,
    greatest(0.0, least(0.1, 0.4412 / (t.n * log2(t.n + 1) ^ 2) * 0.05 + coalesce(list_sum(list_transform(r.hits, lambda h, j: 0.4412 / ((t.n - h) * log2(t.n - h + 1) ^ 2) * CASE WHEN j = 1 THEN 0.05 ELSE 0.1 END)), 0))) AS a
    FROM r JOIN t ON t.n = r.n + 1))
SELECT n, round(alpha, 8) AS alpha, rejected, round(wealth, 8) AS wealth FROM r WHERE n > 0""",
    "retrieval": """
WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linestatus = 'O'), []) AS f, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'N'), []) AS t FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, CASE WHEN len(f) = 0 THEN 0.0 ELSE len(list_intersect(f, t)) / len(f) END AS p, CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_intersect(f, t)) / len(t) END AS r FROM s),
x AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM p)
SELECT o_orderpriority, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1, round(100 * avg(CASE WHEN f1 >= 1 THEN 1.0 ELSE 0.0 END), 4) AS perfect_pct FROM x JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
}
