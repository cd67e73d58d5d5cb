"""Queries of replay, consensus, mining, retrieval, decisions and text functions over the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.functions import prompts as templates
from engramark.functions import text
from engramark.operators import canonical, consensus, gates, lifecycle, mentions, metrics, replay
from engramark.operators.lifecycle import DAY
from engramark.plans.canonicalization import _variants, _VARIANTS_SQL
from engramark.plans.lifecycle import QUERIES as QUERIES_OF_LIFECYCLE
from engramark.plans.lifecycle import SQL as SQL_OF_LIFECYCLE
from engramark.sinks import artifacts
from engramark.sources import generators
from engramark.sources.workloads import SURFACE_SQL, TOKENS_SQL, surface_forms, table

#: The words that a name gets more of, so that names are near but unequal.
MORE = ("", " of steel", " of old steel", " for one 7", " 7")
FACTS = 40


def longer_forms(spark: SparkSession, d: str) -> DataFrame:
    """The parts' names with a few more words."""
    x = surface_forms(spark, d)
    more = F.element_at(F.array(*map(F.lit, MORE)), (F.col("seq") % len(MORE) + 1).cast("int"))
    return x.withColumn("input", F.concat(F.col("oracle"), more))


def graph_log(spark: SparkSession, d: str) -> DataFrame:
    """The event log of orders as facts about parts: nodes when first seen, edges that go after FACTS days, queries a day later, and pins."""
    item = table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.unix_timestamp("l_shipdate").cast("double").alias("at"), "l_linestatus", "l_partkey")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, rank: int, op: str, ts, node=none, kind=none, src=none, dst=none) -> DataFrame:
        return df.select(ts.alias("ts"), F.lit(rank).alias("rank"), F.lit(op).alias("op"), node.alias("node_id"), kind.alias("kind"), src.alias("src"), dst.alias("dst"))

    first = lambda end, kind: item.groupBy(F.col(end).alias("n")).agg(F.min("at").alias("at")).select("n", "at", F.lit(kind).alias("k"))
    nodes = first("src", "fact").unionByName(first("dst", "entity"))
    pins = item.where("l_partkey % 50 = 0").groupBy("dst").agg(F.min("at").alias("at"))
    parts = [
        rows(nodes, 0, "add_node", F.col("at"), F.col("n"), F.col("k")), rows(pins, 1, "pin", F.col("at"), F.col("dst")),
        rows(item, 2, "add_edge", F.col("at"), src=F.col("src"), dst=F.col("dst")), rows(item, 3, "remove_edge", F.col("at") + FACTS * DAY, src=F.col("src"), dst=F.col("dst")),
        rows(item.where("l_linestatus = 'O'"), 4, "query", F.col("at") + DAY, F.col("dst")),
    ]
    return lifecycle.numbered(reduce(DataFrame.unionByName, parts), "ts", "rank", "node_id", "src", "dst").drop("day", "rank")


def event_state(spark: SparkSession, d: str) -> DataFrame:
    """Every node's state after the whole log."""
    # The log is read many times: it is numbered once.
    x = replay.stored(graph_log(spark, d))
    graph = replay.applied(replay.empty(x), x)
    return graph.nodes.select("node_id", "kind", "added_at", "in_degree", "out_degree", "last_access", "query_count")


def collected_graph(spark: SparkSession, d: str) -> DataFrame:
    """The nodes that are left after the first half of the log when every seventh fact is collected with its edges, pinned ones apart, and their degrees."""
    log = replay.stored(graph_log(spark, d))
    x = log.where(F.col("i") <= F.lit(log.count() / 2))
    graph = replay.applied(replay.empty(x), x)
    # What goes is found among the nodes and edges that lose it.
    graph = graph._replace(nodes=replay.stored(graph.nodes), edges=replay.stored(graph.edges))
    gone = graph.nodes.where((F.col("kind") == "fact") & (F.substring("node_id", 2, 20).cast("long") % 7 == 0)).select("node_id")
    left = replay.collected(graph, gone)
    return left.nodes.select("node_id", "kind", "in_degree", "out_degree")


def tombstone_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Tombstones of collected facts by segment of their keys: superseded ones found by a later question, and those left and evicted when the last is written."""
    facts = QUERIES_OF_LIFECYCLE["fact_sweeps"](spark, d).where("tick is not null")
    tombs = facts.select(F.col("fact").alias("node_id"), "collected_at", F.when(F.col("fact") % 3 == 0, F.concat(F.lit("o"), F.col("fact") + 1)).alias("superseded_by"))
    asked = facts.select(F.col("fact").alias("node_id"), (F.col("added_at") + (60 + F.col("fact") % 40) * DAY).alias("asked_at"))
    part = lambda c: (F.col(c) % 5).alias("segment")
    found = replay.superseded_lookup(asked, tombs).groupBy(part("node_id")).agg(F.count("*").alias("found"))
    t = tombs.agg(F.max("collected_at")).first()[0] or 0.0
    left, evicted = replay.pruned(tombs, t)
    kept = left.groupBy(part("node_id")).agg(F.count("*").alias("left"))
    out = tombs.groupBy(part("node_id")).agg(evicted)
    return out.join(kept, "segment", "left").join(found, "segment", "left").select("segment", "evicted", F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("found", F.lit(0)).alias("found"))


def event_counts(spark: SparkSession, d: str) -> DataFrame:
    return replay.op_counts(graph_log(spark, d))


def replay_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates UC-GC-1 to 5 of a rule over the whole log with sweeps in between; writes aren't timed here."""
    log = replay.stored(graph_log(spark, d))
    n = log.count()
    run = replay.replayed(log, "conservative_entity", max(1, n // 2), survivors=log.where("op = 'pin'").select("node_id").distinct())
    nodes = log.where("op = 'add_node'").agg(F.countDistinct("node_id").alias("n"), F.countDistinct(F.when(F.col("kind") == "entity", F.col("node_id"))).alias("entities"))
    left = run.graph.nodes.agg(F.count("*").alias("left"), F.count_if(F.col("kind") == "entity").alias("entities_left"))
    asked = run.tombstones.agg(F.count("*").alias("targets"), F.count_if(lifecycle.tombstone_hit(F.col("collected_at") + 3 * DAY, F.col("collected_at"))).alias("recovered"))
    x = nodes.crossJoin(left).crossJoin(asked)
    reduction = 100.0 * (F.col("n") - F.col("left")) / F.col("n")
    rows = gates.lifecycle_gates(reduction, F.col("entities_left") / F.col("entities"), F.lit(100.0 * run.counts["false_collections"]) / F.greatest(F.lit(1), F.col("entities")), F.lit(0.0), F.col("recovered"), F.col("targets"))
    return x.select(F.inline(F.array(*rows)))


def _writes(spark: SparkSession, d: str) -> DataFrame:
    """The writes of names as local labels, with vectors of their letters."""
    x = surface_forms(spark, d).withColumn("label", F.lower(F.split_part("oracle", F.lit(" "), F.lit(2))))
    vector = F.transform(F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz")), lambda c: F.length("oracle") - F.length(F.replace("oracle", c, F.lit("")))).cast("array<double>")
    return x.select("seq", "source_id", "input", "label", vector.alias("vector"))


def consensus_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason decides, for the rule that asks for any evidence and the one that asks for all."""
    w = replay.reliable(_writes(spark, d))
    either = consensus.judged_pairs(w, "any", 0.3, 0.95).groupBy("reason").agg(F.count("*").alias("n"))
    rows = [either.select(F.lit("any").alias("rule"), "reason", "n"), consensus.reason_counts(w, 0.3, 0.95).select(F.lit("all").alias("rule"), "reason", "n")]
    return reduce(DataFrame.unionByName, rows)


def consensus_names(spark: SparkSession, d: str) -> DataFrame:
    """Names after consensus with the settings that the data ask for, and identity merges where most keys have one alias."""
    w = replay.reliable(_writes(spark, d))
    every, _ = consensus.adaptive(w, 0.3, 0.95)
    return consensus.identity_merges(every, w).select("source_id", "label", "merged")


def mined_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different names whose letters are nearly alike, most alike first in their digest order."""
    names = table(spark, d, "part").select(F.col("p_name").alias("k")).distinct()
    counts = names.select("k", F.posexplode(F.transform(F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz")), lambda c: F.length("k") - F.length(F.replace("k", c, F.lit(""))))).alias("i", "m")).where("m > 0")
    norm = counts.groupBy("k").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    pairs = consensus.near_pairs(counts.join(norm, "k").select("k", "i", (F.col("m") / F.col("norm")).alias("c")), 0.85)
    return pairs.select("u", "v", F.round("cosine", 6).alias("cosine"))


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Different names in the order in which they first come."""
    x = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first"))
    return lifecycle.numbered(x.withColumn("ts", F.col("first").cast("double")), "ts", "first").select("p_name", "first", "i")


def form_reduction(spark: SparkSession, d: str) -> DataFrame:
    x = _variants(spark, d).join(surface_forms(spark, d).select("seq", "input"), "seq")
    return metrics.reduction(x, "variant").select("variant", "n", F.round("accuracy", 6).alias("accuracy"), "forms", "labels", F.round("reduction_pct", 4).alias("reduction_pct"))


def rand_index(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_rand(_variants(spark, d), "variant").select("variant", F.round("ari", 6).alias("ari"))


def memories_by_oracle(spark: SparkSession, d: str) -> DataFrame:
    """Forms of each oracle."""
    return surface_forms(spark, d).groupBy("oracle").agg(F.count("*").alias("n"), F.countDistinct("input").alias("forms"))


def top_k(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the five largest parts of each brand as answers for its standard ones."""
    p = table(spark, d, "part")
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey"))
    x = metrics.top_k_retrieval(p.select(F.col("p_brand").alias("canonical"), rank.alias("rank"), (F.col("p_type") == "STANDARD").alias("relevant")), 5)
    return x.select("canonical", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def set_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the open against the unreturned parts of each order, both of which may be empty."""
    item = table(spark, d, "lineitem")
    empty = F.expr("cast(array() as array<bigint>)")
    x = item.groupBy("l_orderkey").agg(F.coalesce(F.collect_set(F.when(F.col("l_linestatus") == "O", F.col("l_partkey"))), empty).alias("a"), F.coalesce(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))), empty).alias("b"))
    return x.select("l_orderkey", *(F.round(c, 6).alias(k) for k, c in metrics.either_empty(F.col("a"), F.col("b")).items()))


def separations(spark: SparkSession, d: str) -> DataFrame:
    """Medians of prices of standard and other parts, and how often another's is at least a standard one's."""
    x = metrics.separation(table(spark, d, "part").select(F.col("p_size").cast("double").alias("score"), (F.col("p_type") == "STANDARD").alias("positive")))
    return x.select("positive_median", "negative_median", F.round("overlap", 8).alias("overlap"))


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of each nation's customers that are in debt with its interval, by reproducible resamples."""
    c = table(spark, d, "customer").withColumn("debt", F.col("c_acctbal") < 0)
    x = metrics.rate_interval(c, "debt", 200, 5, "c_nationkey")
    return x.select("c_nationkey", *(F.round(y, 6).alias(y) for y in ("rate", "lo", "hi")))


#: Names and notes that parts of the given table are told apart by, with every kind that a verdict looks at.
KINDS = ("tool-", "prompt-", "policy-", "recovery-", "embed-proxy-", "gc-", "b-raw-identity", "x-")
NOTES = ("", "", "", "Do not deploy with c", "superseded by g", "conditional on h", "cross-dim still loses", "fails UC-4")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """What to build, of every supplier as a variant: its balance is the lift in per cent, its key tells kind, effort, interval and note."""
    key = F.col("s_suppkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.floor(key / n) % len(xs) + 1).cast("int"))
    lift = F.col("s_acctbal").cast("double") / 250
    x = table(spark, d, "supplier").select(
        F.concat(pick(KINDS, 1), key.cast("string")).alias("variant"), lift.alias("lift"), F.when(key % 3 == 0, lift - 2).alias("low"), F.when(key % 6 == 0, lift + 2).alias("high"),
        F.when(key % 11 != 0, (key % 7 + 1) / 2).alias("weeks"), pick(NOTES, 5).alias("note"),
    )
    y = gates.build_verdicts(x)
    return y.select("variant", gates.dimension_of(F.col("variant")).alias("dimension"), F.round("low", 4).alias("low"), F.round("per_week", 4).alias("per_week"), "verdict")


def write_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates and percentiles of the events' values as times, by type, without those that warm up."""
    x = metrics.throughput(table(spark, d, "events").where("value is not null"), "event_id", "value", "event_type")
    return x.select("event_type", "warmed", "measured", F.round("per_second", 6).alias("per_second"), "p50", "p99")


def pair_merges(spark: SparkSession, d: str) -> DataFrame:
    """Each part's name beside a changed one, every pair by a fresh guarded clustering of its own: how many get one label, and the first five that do."""
    p = table(spark, d, "part")
    more = F.element_at(F.array(*map(F.lit, (" of", " 7", " small", " old steel"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    x = metrics.merged_alone(p.select("p_partkey", F.col("p_name").alias("a"), F.concat("p_name", more).alias("b")), 0.7)
    return metrics.with_examples(x, "p_partkey", "merged", ("a", "b"), 5)


def adjusted_prices(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders less what their customers' balances explain."""
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return metrics.adjusted(x, "o_totalprice", "c_acctbal").select("o_orderkey", F.round("adjusted", 2).alias("adjusted"))


def decisions(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline's decision on each nation's customers as tests, on the fast tier: debts are regressions, round sums unclear."""
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 97 == 0, "guardrail_kill_switch").otherwise("paired")
    outcome = F.when((kind == "guardrail_kill_switch") & (F.col("c_custkey") % 2 == 0), "FAIL").when(F.col("c_acctbal") < -990, "REGRESSION").when(F.col("c_custkey") % 211 == 0, "INCONCLUSIVE").otherwise("SUPERIOR")
    x = gates.pipeline_decision(c.select("c_nationkey", kind.alias("type"), outcome.alias("outcome")), "fast", "c_nationkey")
    return x.select("c_nationkey", "decision", F.array_join("reasons", ", ").alias("reasons"))


def sweep_quality(spark: SparkSession, d: str) -> DataFrame:
    """Gate of what is preserved when each segment loses its customers in debt, and the segments' order."""
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("variant")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") >= 0).alias("left"))
    x = c.select("variant", (100.0 * (F.col("n") - F.col("left")) / F.col("n")).alias("reduction_pct"), (100.0 * F.col("left") / F.col("n")).alias("preservation_pct"), gates.retrieval_gate(F.lit(1.0), F.col("left") / F.col("n")).alias("gate"))
    return gates.sweep_ranking(x).select("variant", F.round("reduction_pct", 4).alias("reduction_pct"), "verdict", "gate.value", "gate.status")


def latency_gates(spark: SparkSession, d: str) -> DataFrame:
    """The kill switch on errors and the limit of the 99th percentile of values by event type."""
    e = table(spark, d, "events")
    counts = e.groupBy("event_type", "value").agg(F.count("*").alias("n"))
    p99 = metrics.percentile_of_counts(counts, "value", "n", 0.99, "event_type")
    share = 100.0 * F.count_if(F.col("value") > 50) / F.count("*")
    x = e.groupBy("event_type").agg(share.alias("share")).join(p99, "event_type")
    return gates.gate_rows(x, ("event_type",), [gates.at_most("UC-4.4", F.col("share")), gates.below("UC-4.6", F.col("percentile"))])


def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of each part's name in every template, and of the answer that its type would be cleaned to."""
    p = table(spark, d, "part").select("p_partkey", *(F.sha2(templates.rendered(v, F.col("p_name")), 256).alias(v) for v in templates.TEMPLATES), templates.first_line(F.concat(F.lit('\n "'), "p_type", F.lit('." \nmore'))).alias("answer"))
    return p


def replaced_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with the first place of each alias replaced, the canonical of their second word, and words found apart."""
    aliases = {"small ring": "ring s", "ring": "band", "small": "tiny"}
    known = mentions.alias_map(spark.createDataFrame([(0, "ring", "old"), (1, "bolt", "screw"), (2, "ring", "circle")], "seq long, alias string, canonical string"))
    x = table(spark, d, "part").select("p_partkey", "p_name", F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word"))
    x = mentions.looked_up(x, known, "word")
    return x.select("p_partkey", mentions.replaced_once(F.col("p_name"), aliases).alias("replaced"), "canonical", F.size(mentions.apart(F.concat_ws(" ", "p_name", "p_name"), ("small", "ring"))).alias("found"))


def chunked_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of each source's rows in order by digests of chunks, so that no row holds a source."""
    return artifacts.chained_sha256(surface_forms(spark, d), "seq", F.concat("input", F.lit("\x1f"), "oracle", F.lit("\x1e")), "source_id", chunk=100)


def churn_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a generated log holds."""
    return generators.log_stats(generators.churn(spark, 50, 400, seed=3))


QUERIES = {f.__name__: f for f in (event_state, collected_graph, tombstone_lookups, event_counts, replay_gates, consensus_reasons, consensus_names, mined_pairs, first_seen, form_reduction, rand_index, memories_by_oracle, top_k, set_scores, separations, rates, verdicts, write_rates, pair_merges, adjusted_prices, decisions, sweep_quality, latency_gates, rendered_prompts, replaced_names, chunked_fingerprint, churn_stats)}

_U = "CAST(('0x' || substr(sha256({}), 1, 8)) AS UBIGINT) / 4294967296.0"
_EV = f"""it AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, CAST(epoch(l_shipdate) AS DOUBLE) AS moment, l_linestatus, l_partkey FROM lineitem),
ev AS (
  SELECT moment AS ts, 0 AS rk, 'add_node' AS op, n AS node_id, k AS kind, NULL AS src, NULL AS dst FROM (SELECT src AS n, min(moment) AS moment, 'fact' AS k FROM it GROUP BY 1 UNION ALL SELECT dst, min(moment), 'entity' FROM it GROUP BY 1)
  UNION ALL SELECT min(moment), 1, 'pin', dst, NULL, NULL, NULL FROM it WHERE l_partkey % 50 = 0 GROUP BY dst
  UNION ALL SELECT moment, 2, 'add_edge', NULL, NULL, src, dst FROM it UNION ALL SELECT moment + {FACTS} * 86400, 3, 'remove_edge', NULL, NULL, src, dst FROM it
  UNION ALL SELECT moment + 86400, 4, 'query', dst, NULL, NULL, NULL FROM it WHERE l_linestatus = 'O')"""
_VECTOR = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: CAST(length({0}) - length(replace({0}, c, '')) AS DOUBLE))"
_MINED = f"""nm AS (SELECT DISTINCT p_name AS k, {_VECTOR.format('p_name')} AS v FROM part),
mined AS (SELECT a.k AS u, b.k AS v, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM nm a JOIN nm b ON a.k < b.k WHERE list_cosine_similarity(a.v, b.v) >= 0.85)"""
_KEYS = f"""{SURFACE_SQL},
wr AS (SELECT seq, source_id, input, lower(split_part(oracle, ' ', 2)) AS label, {_VECTOR.format('oracle')} AS vec FROM surface),
ky AS (SELECT source_id || '::' || label AS k, source_id, label, min(seq) AS place, list_distinct(list(input)) AS al FROM wr GROUP BY source_id, label),
cv AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT source_id || '::' || label AS k, i, avg(vec[i]) AS m FROM wr, range(1, 27) r(i) GROUP BY 1, 2) GROUP BY k),
pr AS (SELECT a.k AS u, b.k AS v, len(list_intersect(a.al, b.al)) AS c, len(list_distinct(list_concat(a.al, b.al))) AS n, list_cosine_similarity(x.c, y.c) AS cs
  FROM ky a JOIN ky b ON a.source_id <> b.source_id AND a.place < b.place JOIN cv x ON x.k = a.k JOIN cv y ON y.k = b.k WHERE len(a.al) >= 2 AND len(b.al) >= 2)"""

_KINDS, _NOTES = (", ".join(f"'{x}'" for x in xs) for xs in (KINDS, NOTES))
SQL = {
    "event_state": f"""
WITH {_EV}, lg AS (SELECT *, row_number() OVER (ORDER BY ts, rk, node_id NULLS FIRST, src NULLS FIRST, dst NULLS FIRST) AS i FROM ev),
nd AS (SELECT node_id, any_value(kind) AS kind, min(ts) AS added_at, min(i) AS since FROM lg WHERE op = 'add_node' GROUP BY node_id),
e1 AS (SELECT i, src, dst, CASE op WHEN 'add_edge' THEN 1 ELSE -1 END AS step FROM lg WHERE op IN ('add_edge', 'remove_edge')),
e2 AS (SELECT *, sum(step) OVER w AS run FROM e1 WINDOW w AS (PARTITION BY src, dst ORDER BY i)),
ch AS (SELECT i, src, dst, CASE WHEN step = 1 THEN 1 WHEN run = 0 THEN -1 ELSE 0 END AS change FROM e2),
dg AS (SELECT node, side, sum(change) AS total, sum(change) - least(0, min(run)) AS degree FROM (
  SELECT node, side, change, sum(change) OVER (PARTITION BY node, side ORDER BY i) AS run FROM (SELECT i, dst AS node, 'in' AS side, change FROM ch UNION ALL SELECT i, src, 'out', change FROM ch)) GROUP BY node, side),
qu AS (SELECT node_id, max(ts) AS last, count(*) AS n FROM lg WHERE op = 'query' GROUP BY node_id)
SELECT nd.node_id, nd.kind, nd.added_at, CAST(coalesce(a.degree, 0) AS BIGINT) AS in_degree, CAST(coalesce(b.degree, 0) AS BIGINT) AS out_degree, coalesce(qu.last, nd.added_at) AS last_access, coalesce(qu.n, 0) AS query_count
FROM nd LEFT JOIN dg a ON a.node = nd.node_id AND a.side = 'in' LEFT JOIN dg b ON b.node = nd.node_id AND b.side = 'out' LEFT JOIN qu ON qu.node_id = nd.node_id""",
    "collected_graph": f"""
WITH {_EV}, lg AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY ts, rk, node_id NULLS FIRST, src NULLS FIRST, dst NULLS FIRST) AS i FROM ev) WHERE i <= (SELECT count(*) / 2 FROM ev)),
nd AS (SELECT node_id, any_value(kind) AS kind FROM lg WHERE op = 'add_node' GROUP BY node_id),
e1 AS (SELECT i, src, dst, CASE op WHEN 'add_edge' THEN 1 ELSE -1 END AS step FROM lg WHERE op IN ('add_edge', 'remove_edge')),
e2 AS (SELECT *, sum(step) OVER w AS run FROM e1 WINDOW w AS (PARTITION BY src, dst ORDER BY i)),
ch AS (SELECT i, src, dst, CASE WHEN step = 1 THEN 1 WHEN run = 0 THEN -1 ELSE 0 END AS change FROM e2),
dg AS (SELECT node, side, sum(change) - least(0, min(run)) AS degree FROM (
  SELECT node, side, change, sum(change) OVER (PARTITION BY node, side ORDER BY i) AS run FROM (SELECT i, dst AS node, 'in' AS side, change FROM ch UNION ALL SELECT i, src, 'out', change FROM ch)) GROUP BY node, side),
al AS (SELECT src, dst FROM e1 GROUP BY src, dst HAVING sum(step) > 0),
gn AS (SELECT node_id FROM nd WHERE kind = 'fact' AND CAST(substr(node_id, 2) AS BIGINT) % 7 = 0),
ls AS (SELECT dst, count(*) AS n FROM al WHERE src IN (FROM gn) GROUP BY dst)
SELECT nd.node_id, nd.kind, CAST(greatest(0, coalesce(a.degree, 0) - coalesce(ls.n, 0)) AS BIGINT) AS in_degree, CAST(coalesce(b.degree, 0) AS BIGINT) AS out_degree
FROM nd LEFT JOIN dg a ON a.node = nd.node_id AND a.side = 'in' LEFT JOIN dg b ON b.node = nd.node_id AND b.side = 'out' LEFT JOIN ls ON ls.dst = nd.node_id WHERE nd.node_id NOT IN (FROM gn)""",
    "tombstone_lookups": f"""WITH fs AS (SELECT * FROM ({SQL_OF_LIFECYCLE['fact_sweeps']}) WHERE tick IS NOT NULL), m AS (SELECT max(collected_at) AS t FROM fs)
SELECT fact % 5 AS segment, count(*) FILTER (t - collected_at > 604800) AS evicted, count(*) FILTER (t - collected_at <= 604800) AS left,
  count(*) FILTER (fact % 3 = 0 AND added_at + (60 + fact % 40) * 86400 - collected_at <= 604800) AS found FROM fs, m GROUP BY 1""",
    "event_counts": f"WITH {_EV} SELECT " + ", ".join(f"count(*) FILTER (op = '{o}') AS {o}" for o in ("add_node", "add_edge", "remove_edge", "query", "pin")) + ", count(*) AS events FROM ev",
    "consensus_reasons": f"""WITH {_KEYS}, j AS (SELECT *, c / n >= 0.3 AS jo, cs >= 0.95 - 1e-12 AS co FROM pr)
SELECT 'any' AS rule, CASE WHEN jo AND co THEN 'both' WHEN jo THEN 'jaccard_only' ELSE 'cosine_only' END AS reason, count(*) AS n FROM j WHERE jo OR co GROUP BY 2
UNION ALL SELECT 'all', CASE WHEN jo AND co THEN 'and_passed' WHEN jo THEN 'blocked_cosine_below' WHEN co THEN 'blocked_jaccard_below' ELSE 'blocked_both' END, count(*) FROM j WHERE c >= 2 GROUP BY 2
UNION ALL SELECT 'all', 'blocked_overlap_below_min', count(*) FROM j WHERE c < 2 HAVING count(*) > 0""",
    "mined_pairs": f"WITH {_MINED} SELECT u, v, cosine FROM mined",
    "first_seen": "SELECT p_name, min(p_partkey) AS first, row_number() OVER (ORDER BY min(p_partkey)) AS i FROM part GROUP BY p_name",
    "form_reduction": f"WITH {_VARIANTS_SQL} SELECT variant, count(*) AS n, round(avg(CASE WHEN label = l.oracle THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(DISTINCT input) AS forms, count(DISTINCT label) AS labels, round(100.0 * (count(DISTINCT input) - count(DISTINCT label)) / count(DISTINCT input), 4) AS reduction_pct FROM labelled l JOIN surface USING (seq) GROUP BY variant",
    "rand_index": f"""WITH {_VARIANTS_SQL}, c AS (SELECT variant, label, oracle, count(*) AS n FROM labelled GROUP BY ALL),
a AS (SELECT variant, sum(n * (n - 1) / 2) AS v, sum(n) * (sum(n) - 1) / 2 AS t FROM c GROUP BY variant),
p AS (SELECT variant, sum(n * (n - 1) / 2) AS v FROM (SELECT variant, label, sum(n) AS n FROM c GROUP BY ALL) GROUP BY variant), o AS (SELECT variant, sum(n * (n - 1) / 2) AS v FROM (SELECT variant, oracle, sum(n) AS n FROM c GROUP BY ALL) GROUP BY variant)
SELECT a.variant, round(CASE WHEN (p.v + o.v) / 2 = p.v * o.v / a.t THEN 1.0 ELSE (a.v - p.v * o.v / a.t) / ((p.v + o.v) / 2 - p.v * o.v / a.t) END, 6) AS ari FROM a JOIN p USING (variant) JOIN o USING (variant)""",
    "memories_by_oracle": f"WITH {SURFACE_SQL} SELECT oracle, count(*) AS n, count(DISTINCT input) AS forms FROM surface GROUP BY oracle",
    "top_k": """WITH r AS (SELECT p_brand, p_type = 'STANDARD' AS ok, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS k FROM part),
c AS (SELECT p_brand, count(*) FILTER (ok AND k <= 5) AS hit, count(*) FILTER (k <= 5) AS f, count(*) FILTER (ok) AS t FROM r GROUP BY 1), s AS (SELECT p_brand, CASE WHEN f > 0 THEN hit / f ELSE 0 END AS p, CASE WHEN t > 0 THEN hit / t ELSE 0 END AS r FROM c)
SELECT p_brand AS canonical, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""",
    "set_scores": """WITH s AS (SELECT l_orderkey, coalesce(list(DISTINCT l_partkey) FILTER (l_linestatus = 'O'), []) AS a, coalesce(list(DISTINCT l_partkey) FILTER (l_returnflag = 'R'), []) AS b FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(a) END AS p, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(b) END AS r FROM s)
SELECT l_orderkey, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM x""",
    "separations": """WITH p AS (SELECT CAST(p_size AS DOUBLE) AS s, p_type = 'STANDARD' AS ok FROM part)
SELECT median(s) FILTER (ok) AS positive_median, median(s) FILTER (NOT ok) AS negative_median, round((SELECT avg(CASE WHEN n.s >= q.s THEN 1.0 ELSE 0.0 END) FROM p n, p q WHERE NOT n.ok AND q.ok), 8) AS overlap FROM p""",
    "rates": f"""WITH b AS (SELECT c_nationkey, count(*) AS n, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END) AS rate FROM customer GROUP BY 1),
m AS (SELECT c_nationkey, r.range AS rep, avg(CASE WHEN {_U.format("'5:' || r.range || ':' || t.range")} < rate THEN 1.0 ELSE 0.0 END) AS m FROM b, range(200) r, range((SELECT max(n) FROM b)) t WHERE t.range < n GROUP BY 1, 2),
s AS (SELECT c_nationkey, list_sort(list(m)) AS ms FROM m GROUP BY 1) SELECT c_nationkey, round(rate, 6) AS rate, round(ms[6], 6) AS lo, round(ms[195], 6) AS hi FROM b JOIN s USING (c_nationkey)""",
    "verdicts": f"""WITH s AS (SELECT s_suppkey AS k, CAST(s_acctbal AS DOUBLE) / 250 AS lift, [{_KINDS}][s_suppkey % {len(KINDS)} + 1] AS kind, [{_NOTES}][(s_suppkey // 5) % {len(NOTES)} + 1] AS note, CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey % 7 + 1) / 2 END AS weeks FROM supplier),
t AS (SELECT *, CASE WHEN k % 3 = 0 THEN lift - 2 ELSE lift - abs(lift) * 0.15 END AS lo FROM s)
SELECT kind || k AS variant, CASE kind WHEN 'tool-' THEN 'tools' WHEN 'prompt-' THEN 'prompt' WHEN 'policy-' THEN 'execution policy' WHEN 'recovery-' THEN 'recovery' WHEN 'embed-proxy-' THEN 'memory (canonicalization)' WHEN 'gc-' THEN 'memory (lifecycle)' ELSE 'unknown' END AS dimension,
  round(lo, 4) AS low, round(CASE WHEN weeks > 0 THEN greatest(0.0, lo) / weeks END, 4) AS per_week,
  CASE WHEN lift <= 0 THEN 'DO-NOT-BUILD' WHEN weeks IS NULL THEN 'INSUFFICIENT-DATA' WHEN note IN ('Do not deploy with c', 'cross-dim still loses') THEN 'DO-NOT-BUILD' WHEN note <> '' THEN 'DEFER' WHEN lo >= 5 AND weeks <= 2 THEN 'FUND-NOW' WHEN lo >= 10 AND weeks <= 5 THEN 'FUND-Q+1' ELSE 'DEFER' END AS verdict FROM t""",
    "write_rates": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
m AS (SELECT event_type, any_value(n) AS n, list_sort(list(value)) AS v FROM r WHERE k > least(50, n // 20) GROUP BY 1)
SELECT event_type, n - len(v) AS warmed, len(v) AS measured, round(len(v) / (list_sum(v) / 1000), 6) AS per_second, v[CAST(least(len(v) - 1, floor(len(v) * 0.5)) AS BIGINT) + 1] AS p50, v[CAST(least(len(v) - 1, floor(len(v) * 0.99)) AS BIGINT) + 1] AS p99 FROM m""",
    "pair_merges": f"""WITH x AS (SELECT p_partkey, p_name AS a, p_name || [' of', ' 7', ' small', ' old steel'][p_partkey % 4 + 1] AS b FROM part),
w AS (SELECT *, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM x),
c AS (SELECT p_partkey, a, b, list_sum(list_transform(list_distinct(wa), lambda t: len(list_filter(wa, lambda u: u = t)) * len(list_filter(wb, lambda u: u = t)))) / sqrt(
  list_sum(list_transform(list_distinct(wa), lambda t: len(list_filter(wa, lambda u: u = t)) ** 2)) * list_sum(list_transform(list_distinct(wb), lambda t: len(list_filter(wb, lambda u: u = t)) ** 2))) AS cs FROM w),
m AS (SELECT *, cs >= 0.7 AND NOT (b LIKE '% of') AND NOT (b LIKE '% 7') AS merged FROM c)
SELECT count(*) AS n, count(*) FILTER (merged) AS merged, round(100.0 * avg(CASE WHEN merged THEN 1.0 ELSE 0.0 END), 4) AS rate_pct,
  (SELECT string_agg(a || ' = ' || b, '; ' ORDER BY p_partkey) FROM (SELECT * FROM m WHERE merged ORDER BY p_partkey LIMIT 5)) AS examples FROM m""",
    "adjusted_prices": """WITH x AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS y, CAST(c_acctbal AS DOUBLE) AS b FROM orders JOIN customer ON o_custkey = c_custkey), m AS (SELECT covar_samp(y, b) / var_samp(b) AS t, avg(b) AS mb FROM x)
SELECT o_orderkey, round(y - t * (b - mb), 2) AS adjusted FROM x, m""",
    "decisions": """WITH t AS (SELECT c_nationkey, c_custkey % 97 = 0 AS kill, CASE WHEN c_custkey % 97 = 0 AND c_custkey % 2 = 0 THEN 'FAIL' WHEN c_acctbal < -990 THEN 'REGRESSION' WHEN c_custkey % 211 = 0 THEN 'INCONCLUSIVE' ELSE 'SUPERIOR' END AS o FROM customer),
g AS (SELECT c_nationkey, bool_or(o = 'INCONCLUSIVE') AS a, bool_or(o = 'REGRESSION') AS b, bool_or(kill AND o = 'FAIL') AS c FROM t GROUP BY 1)
SELECT c_nationkey, CASE WHEN a OR b OR c THEN 'BLOCK_PR' ELSE 'PASS_AND_MERGE' END AS decision, concat_ws(', ', CASE WHEN a THEN 'inconclusive' END, CASE WHEN b THEN 'regression' END, CASE WHEN c THEN 'kill switch' END) AS reasons FROM g""",
    "sweep_quality": """WITH c AS (SELECT c_mktsegment AS variant, 100.0 * count(*) FILTER (c_acctbal >= 0) / count(*) AS kept FROM customer GROUP BY 1)
SELECT variant, round(100 - kept, 4) AS reduction_pct, CASE WHEN kept >= 95 THEN 'EXCELLENT' WHEN kept >= 80 THEN 'ACCEPTABLE' ELSE 'POOR' END AS verdict, round_even(kept, 2) AS value, CASE WHEN kept >= 80 THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
    "latency_gates": """WITH e AS (SELECT event_type, 100.0 * count(*) FILTER (value > 50) / count(*) AS share, list_sort(list(value))[CAST(least(count(*) - 1, floor(count(*) * 0.99)) AS BIGINT) + 1] AS p99 FROM events GROUP BY 1)
SELECT event_type, 'UC-4.4' AS gate, round_even(share, 3) AS value, CAST(1 AS DOUBLE) AS threshold, CASE WHEN share <= 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM e
UNION ALL SELECT event_type, 'UC-4.6', round_even(p99, 3), 100, CASE WHEN p99 < 100 THEN 'PASS' ELSE 'FAIL' END FROM e""",
    "rendered_prompts": "SELECT p_partkey, " + ", ".join(f"sha256('{a}' || p_name || '{b}') AS {v}".replace("\n", "' || chr(10) || '") if "'" not in a + b else f"sha256('{a.replace(chr(39), chr(39) * 2)}' || p_name || '{b.replace(chr(39), chr(39) * 2)}') AS {v}".replace("\n", "' || chr(10) || '") for v, (a, b) in templates.TEMPLATES.items()) + ", p_type AS answer FROM part",
    "replaced_names": """SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 'band s' ELSE replace(replace(p_name, 'ring', 'band'), 'small', 'tiny') END AS replaced,
  CASE split_part(p_name, ' ', 2) WHEN 'ring' THEN 'circle' WHEN 'bolt' THEN 'screw' ELSE split_part(p_name, ' ', 2) END AS canonical, CAST(len(regexp_extract_all(p_name || ' ' || p_name, '(?:^|[^A-Za-z0-9_])(small|ring)(?:$|[^A-Za-z0-9_])')) AS INT) AS found FROM part""",
    "chunked_fingerprint": f"""WITH {SURFACE_SQL}, c AS (SELECT source_id, seq // 100 AS k, sha256(string_agg(input || chr(31) || oracle || chr(30), '' ORDER BY seq)) AS d FROM surface GROUP BY 1, 2)
SELECT source_id, sha256(string_agg(d, '' ORDER BY k)) AS sha256 FROM c GROUP BY 1""",
}
