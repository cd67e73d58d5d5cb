"""Queries of the memory graph's lifecycle: orders are facts, parts are entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.operators import lifecycle
from engramark.operators.graph import reliable
from engramark.operators.lifecycle import DAY
from engramark.sources.workloads import graph_edges, table

LIFETIME = 45 * DAY
MIN_AGE = 60 * DAY
CADENCES = (100, 500, 1000)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_edges(spark, d).withColumn("removed", F.col("l_returnflag") == "R").withColumn("queried", F.col("l_linestatus") == "O")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    x = lifecycle.node_state(_edges(spark, d))
    fact = F.col("kind") == "fact"
    x = x.withColumn("pinned", F.col("num") % 50 == 0).withColumn("tenant_pinned", F.col("num") % 40 == 1)
    return x.withColumn("invalid_at", F.when(fact, F.col("last_removed") + 10 * DAY)).withColumn("superseded_by", F.when(fact & (F.col("num") % 7 == 0), F.concat(F.lit("o:"), (F.col("num") + 1).cast("string"))))


def _now(spark: SparkSession, d: str) -> float:
    return graph_edges(spark, d).agg(F.max("at")).first()[0] or 0.0


def graph_state(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.node_state(_edges(spark, d)).select("node_id", "kind", "added_at", "in_degree", "out_degree", "query_count", "last_access")


def gc_rules(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that each rule collects at the end of the log, by kind."""
    nodes = _nodes(spark, d)
    rules = lifecycle.rules(_now(spark, d))
    counts = nodes.groupBy("kind").agg(F.count("*").alias("nodes"), *(F.count_if(c).alias(k) for k, c in rules.items()))
    pairs = ", ".join(f"'{k}', `{k}`" for k in rules)
    return counts.selectExpr("kind", "nodes", f"stack({len(rules)}, {pairs}) as (variant, collected)")


def gc_gates(spark: SparkSession, d: str) -> DataFrame:
    """Store reduction and survivor recall of each rule, with their verdicts."""
    x = gc_rules(spark, d).groupBy("variant").agg(F.sum("nodes").alias("n"), F.sum("collected").alias("c"), F.sum(F.when(F.col("kind") == "entity", F.col("nodes"))).alias("en"), F.sum(F.when(F.col("kind") == "entity", F.col("collected"))).alias("ec"))
    x = x.select("variant", (100.0 * F.col("c") / F.col("n")).alias("reduction"), (1 - F.col("ec") / F.col("en")).alias("recall"))
    return x.select("variant", F.round("reduction", 4).alias("reduction_pct"), F.round("recall", 6).alias("entity_recall"), F.when(F.col("reduction") >= 0, "PASS").otherwise("FAIL").alias("gate_reduction"), F.when(F.col("recall") >= 0.95, "PASS").otherwise("FAIL").alias("gate_recall"))


def gc_evidence(spark: SparkSession, d: str) -> DataFrame:
    facts = _nodes(spark, d).where("kind = 'fact'")
    return lifecycle.outdated_evidence(facts, graph_edges(spark, d), _now(spark, d))


def gc_isolation(spark: SparkSession, d: str) -> DataFrame:
    """Components of users and their events that are idle for two days."""
    e = table(spark, d, "events").select(F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("u"), F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("v"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    e = e.withColumn("at", F.col("us") / 1e6)
    pin = F.substring("node_id", -1, 1) == "7"
    users = e.groupBy(F.col("u").alias("node_id")).agg(F.min("at").alias("added_at"), F.max("at").alias("last_access"))
    nodes = users.unionByName(e.select(F.col("v").alias("node_id"), F.col("at").alias("added_at"), F.col("at").alias("last_access"))).withColumn("pinned", pin & F.startswith("node_id", F.lit("u")))
    t = e.agg(F.max("at")).first()[0] or 0.0
    found = lifecycle.isolated(nodes, e.select("u", "v"), t, idle=0.25 * DAY)
    return found.groupBy(F.substring("node_id", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("component").alias("components"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = graph_edges(spark, d)
    add = e.select("fact", "entity", F.col("at").alias("ts"), F.lit(1).alias("op"), "l_linenumber")
    drop = e.select("fact", "entity", (F.col("at") + LIFETIME).alias("ts"), F.lit(-1).alias("op"), "l_linenumber")
    return lifecycle.numbered(add.unionByName(drop), "ts", "op", "fact", "l_linenumber", "entity")


def fact_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.fact_sweeps(reliable(_log(spark, d)), 500, MIN_AGE)


def cadence_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Facts collected, mean wait and tombstone recovery at several sweep cadences; each fact is queried some days after it turned old enough."""
    log = reliable(_log(spark, d))
    spans = reliable(lifecycle.idle_spans(log))
    query = F.col("added_at") + MIN_AGE + (F.col("fact") % 14) * DAY
    rows = []
    for every in CADENCES:
        x = lifecycle.fact_sweeps(log, every, MIN_AGE, spans).withColumn("hit", lifecycle.tombstone_hit(query, F.col("collected_at")))
        rows.append(x.agg(F.lit(every).alias("cadence"), F.count("*").alias("facts"), F.count("tick").alias("collected"), F.round(F.avg(F.col("collected_at") - F.col("added_at")) / DAY, 4).alias("mean_days"), F.round(100 * F.avg(F.col("hit").cast("double")), 4).alias("recovery_pct")))
    return reduce(DataFrame.unionByName, rows)


def growth_curve(spark: SparkSession, d: str) -> DataFrame:
    """Edges added, removed and alive at the end of each 30 days."""
    x = _log(spark, d).groupBy((F.floor(F.col("ts") / DAY / 30)).alias("period")).agg(F.count_if(F.col("op") == 1).alias("added"), F.count_if(F.col("op") == -1).alias("removed"))
    from pyspark.sql import Window

    return x.withColumn("alive", F.sum(F.col("added") - F.col("removed")).over(Window.orderBy("period")))


def top_pins(spark: SparkSession, d: str) -> DataFrame:
    """The twenty entities mentioned most, the first seen of equals."""
    return graph_edges(spark, d).groupBy("entity").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy(F.desc("n"), "first", "entity").limit(20).select("entity", "n")


def capped_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Per part, its first three orders: a capped scan."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity").orderBy("at", "fact", "l_linenumber")
    return graph_edges(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 3").select("entity", "fact", "r")


QUERIES = {f.__name__: f for f in (graph_state, gc_rules, gc_gates, gc_evidence, gc_isolation, fact_sweeps, cadence_matrix, growth_curve, top_pins, capped_mentions)}

_STATE = """ed AS (SELECT l_orderkey AS fact, l_partkey AS entity, CAST(epoch(l_shipdate) AS DOUBLE) AS moment, l_returnflag = 'R' AS removed, l_linestatus = 'O' AS queried, l_linenumber FROM lineitem),
ee AS (SELECT fact, entity, count(*) AS n, count(*) FILTER (removed) AS r, min(moment) AS moment, count(*) FILTER (queried) AS q, max(moment) FILTER (queried) AS last, max(moment) FILTER (removed) AS gone FROM ed GROUP BY ALL),
nodes AS (
  SELECT 'o:' || fact AS node_id, fact AS num, 'fact' AS kind, min(moment) AS added_at, 0 AS in_degree, sum(n - CASE WHEN r >= n THEN 1 ELSE 0 END) AS out_degree, sum(q) AS query_count, max(last) AS last_access, max(gone) AS gone FROM ee GROUP BY fact
  UNION ALL
  SELECT 'p:' || entity, entity, 'entity', min(moment), sum(n - CASE WHEN r >= n THEN 1 ELSE 0 END), 0, sum(q), max(last), max(gone) FROM ee GROUP BY entity),
now AS (SELECT max(moment) AS t FROM ed)"""
_RULES = f"""{_STATE},
s AS (SELECT *, (t - added_at) / 86400 AS age, (t - coalesce(last_access, added_at)) / 86400 AS quiet, (t - coalesce(last_access, 0)) / 86400 AS idle0, num % 50 <> 0 AS free, num % 40 <> 1 AS tf, kind = 'fact' AS f, kind = 'entity' AS e, CASE WHEN kind = 'fact' THEN gone + 10 * 86400 END AS inv FROM nodes, now),
b AS (SELECT kind, tf, free AND e AND age >= 7 AND in_degree = 0 AS orphan, free AND f AND age >= 1 AND out_degree = 0 AS unl, free AND e AND in_degree <= 0 AND age >= 30 AND quiet >= 60 AS ide, query_count >= 3 AS busy,
  free AND inv IS NOT NULL AND coalesce(t - inv >= 7 * 86400, false) AS ex, free AND inv IS NULL AND NOT (idle0 < 60 OR query_count >= 3) AS ina, free AND f AND num % 7 = 0 AND age >= 1 AS rep,
  free AND e AND age >= 14 AND exp(-0.1 * quiet) * (1 + ln(1 + query_count)) < 0.05 AS worn FROM s),
v AS (
  SELECT kind, unnest([
    {{'variant': 'no_gc', 'c': false}}, {{'variant': 'ref_count', 'c': orphan}}, {{'variant': 'ref_count_utility', 'c': orphan OR worn}}, {{'variant': 'fact_only', 'c': unl}},
    {{'variant': 'conservative_entity', 'c': unl OR ide}}, {{'variant': 'tenant_pin', 'c': unl AND tf}}, {{'variant': 'comprehensive', 'c': (unl OR ide) AND tf}},
    {{'variant': 'tuned', 'c': unl OR (ide AND NOT busy)}}, {{'variant': 'comprehensive_tuned', 'c': (unl OR (ide AND NOT busy)) AND tf}},
    {{'variant': 'temporal_validity', 'c': ex}}, {{'variant': 'activation_decay', 'c': ina}}, {{'variant': 'supersession', 'c': rep}}]) AS z FROM b),
counted AS (SELECT kind, count(*) AS nodes, z.variant AS variant, count(*) FILTER (z.c) AS collected FROM v GROUP BY kind, z.variant)"""
_LOG = """ed AS (SELECT l_orderkey AS fact, l_partkey AS entity, CAST(epoch(l_shipdate) AS DOUBLE) AS moment, l_linenumber FROM lineitem),
lg AS (SELECT *, row_number() OVER (ORDER BY ts, op, fact, l_linenumber, entity) AS i FROM (SELECT fact, entity, moment AS ts, 1 AS op, l_linenumber FROM ed UNION ALL SELECT fact, entity, moment + 3888000, -1, l_linenumber FROM ed))"""
_SWEEP = f"""{_LOG},
c1 AS (SELECT *, sum(op) OVER (PARTITION BY fact, entity ORDER BY i) AS s FROM lg),
c2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY fact, entity ORDER BY i)) AS c FROM c1),
c3 AS (SELECT *, sum(CASE WHEN op = 1 THEN 1 WHEN c = 0 THEN -1 ELSE 0 END) OVER (PARTITION BY fact ORDER BY i) AS deg, lead(i) OVER (PARTITION BY fact ORDER BY i) AS nx, min(ts) OVER (PARTITION BY fact) AS added_at FROM c2),
tk AS (SELECT i, ts, n FROM lg, (SELECT unnest([100, 500, 1000]) AS n) WHERE i % n = 0 OR i = (SELECT max(i) FROM lg)),
hit AS (SELECT n, fact, min(tk.i) AS tick FROM c3 JOIN tk ON tk.i >= c3.i AND tk.i < coalesce(c3.nx, 9000000000000) AND tk.ts >= c3.added_at + 5184000 WHERE deg = 0 GROUP BY n, fact),
fa AS (SELECT fact, min(ts) AS added_at FROM lg GROUP BY fact),
sw AS (SELECT k.n, fa.fact, fa.added_at, hit.tick, lg.ts AS collected_at FROM fa CROSS JOIN (SELECT unnest([100, 500, 1000]) AS n) k LEFT JOIN hit ON hit.fact = fa.fact AND hit.n = k.n LEFT JOIN lg ON lg.i = hit.tick)"""

SQL = {
    "graph_state": f"WITH {_STATE} SELECT node_id, kind, added_at, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree, CAST(query_count AS BIGINT) AS query_count, last_access FROM nodes",
    "gc_rules": f"WITH {_RULES} SELECT kind, nodes, variant, collected FROM counted",
    "gc_gates": f"""
WITH {_RULES}, g AS (SELECT variant, 100.0 * sum(collected) / sum(nodes) AS red, 1 - sum(collected) FILTER (kind = 'entity') / sum(nodes) FILTER (kind = 'entity') AS rec FROM counted GROUP BY variant)
SELECT variant, round(red, 4) AS reduction_pct, round(rec, 6) AS entity_recall, CASE WHEN red >= 0 THEN 'PASS' ELSE 'FAIL' END AS gate_reduction, CASE WHEN rec >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS gate_recall FROM g""",
    "gc_evidence": f"""
WITH {_STATE}, l AS (SELECT DISTINCT fact, entity FROM ed), x AS (SELECT l.entity, n.node_id, n.num, n.added_at FROM l JOIN nodes n ON n.num = l.fact AND n.kind = 'fact')
SELECT DISTINCT node_id FROM (SELECT *, max(added_at) OVER (PARTITION BY entity) AS newest FROM x), now WHERE added_at < newest AND num % 50 <> 0 AND t - added_at >= 30 * 86400""",
    "gc_isolation": """
WITH u AS (SELECT user_id, count(*) AS n, min(epoch_us(ts)) / 1e6 AS first, max(epoch_us(ts)) / 1e6 AS last FROM events GROUP BY 1), t AS (SELECT max(last) AS t FROM u),
ok AS (SELECT n FROM u, t WHERE user_id % 10 <> 7 AND t - last > 0.25 * 86400 AND t - first >= 7 * 86400)
SELECT * FROM (SELECT 'u' AS kind, count(*) AS n, count(*) AS components FROM ok UNION ALL SELECT 'e', CAST(sum(n) AS BIGINT), count(*) FROM ok) WHERE components > 0""",
    "fact_sweeps": f"WITH {_SWEEP} SELECT fact, added_at, tick, collected_at FROM sw WHERE n = 500",
    "cadence_matrix": f"""
WITH {_SWEEP} SELECT n AS cadence, count(*) AS facts, count(tick) AS collected, round(avg(collected_at - added_at) / 86400, 4) AS mean_days,
  round(100 * avg(CASE WHEN collected_at <= added_at + 5184000 + fact % 14 * 86400 AND added_at + 5184000 + fact % 14 * 86400 - collected_at <= 604800 THEN 1.0 ELSE 0.0 END), 4) AS recovery_pct FROM sw GROUP BY n""",
    "growth_curve": f"""
WITH {_LOG}, p AS (SELECT CAST(floor(ts / 86400 / 30) AS BIGINT) AS period, count(*) FILTER (op = 1) AS added, count(*) FILTER (op = -1) AS removed FROM lg GROUP BY 1)
SELECT period, added, removed, CAST(sum(added - removed) OVER (ORDER BY period) AS BIGINT) AS alive FROM p""",
    "top_pins": "SELECT l_partkey AS entity, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, min(l_shipdate), 1 LIMIT 20",
    "capped_mentions": "SELECT entity, fact, r FROM (SELECT l_partkey AS entity, l_orderkey AS fact, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY epoch(l_shipdate), l_orderkey, l_linenumber) AS INT) AS r FROM lineitem) WHERE r <= 3",
}
