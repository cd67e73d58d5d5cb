"""Replay of a memory graph's event log: exact state, sweeps with feedback, tombstones, and stores as logs.

Events have i (their order), ts, op, node_id, kind, src and dst; op is add_node,
add_edge, remove_edge, query or pin. A sweep is one plan: candidates, tombstones and
anti-joins. Only the ticks are a loop of the driver, as each sees what the last left.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramark.operators import lifecycle
from engramark.operators.graph import reliable, stored
from engramark.operators.lifecycle import DAY

EVIDENCE = ("fact", "episode", "mention")


class Graph(NamedTuple):
    """nodes (node_id, kind, added_at, in_degree, out_degree, last_access, query_count), edges (src, dst, count) and pins (node_id)."""

    nodes: DataFrame
    edges: DataFrame
    pins: DataFrame


def empty(events: DataFrame) -> Graph:
    spark = events.sparkSession
    nodes = spark.createDataFrame([], "node_id string, kind string, added_at double, in_degree long, out_degree long, last_access double, query_count long")
    return Graph(nodes, spark.createDataFrame([], "src string, dst string, count long"), spark.createDataFrame([], "node_id string"))


def applied(graph: Graph, events: DataFrame) -> Graph:
    """The graph after the events, in their order.

    Adding a node again renews its kind and time only. An edge counts for the nodes
    that are there when it is added; removals of an edge that isn't there change
    nothing, and its degrees fall by one when its count comes to 0, never below 0.
    Queries of nodes that aren't there are lost.
    """
    added = events.where("op = 'add_node'").groupBy("node_id").agg(F.min("i").alias("since"), F.min_by("ts", "i").alias("first_ts"), F.max_by("kind", "i").alias("new_kind"), F.max_by("ts", "i").alias("new_at"))
    known = graph.nodes.join(added, "node_id", "full").withColumn("since", F.when(F.col("kind").isNotNull(), F.lit(-1)).otherwise(F.col("since")))
    known = known.select("node_id", "since", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_at", "added_at").alias("added_at"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_degree", "out_degree", "query_count")), F.coalesce("last_access", "first_ts").alias("last_access"))

    edge = Window.partitionBy("src", "dst").orderBy("i")
    base = graph.edges.withColumnRenamed("count", "base")
    log = events.where("op in ('add_edge', 'remove_edge')").select("i", "src", "dst", F.when(F.col("op") == "add_edge", 1).otherwise(-1).alias("step"))
    log = log.join(base, ["src", "dst"], "left").withColumn("base", F.coalesce("base", F.lit(0)))
    log = log.withColumn("run", F.col("base") + F.sum("step").over(edge))
    log = log.withColumn("count", F.col("run") - F.least(F.lit(0), F.min("run").over(edge)))
    log = log.withColumn("before", F.coalesce(F.lag("count").over(edge), "base"))
    log = log.withColumn("change", F.when(F.col("step") == 1, 1).when((F.col("before") > 0) & (F.col("count") == 0), -1).otherwise(0))
    # Both ends' degrees and the edges read the changes: they are made once.
    log = stored(log.select("i", "src", "dst", "count", "change"))
    after = log.groupBy("src", "dst").agg(F.max_by("count", "i").alias("now"))
    edges = graph.edges.join(after, ["src", "dst"], "full").select("src", "dst", F.coalesce("now", "count").alias("count")).where("count > 0")

    def degrees(end: str, degree: str) -> DataFrame:
        own = Window.partitionBy("node_id").orderBy("i")
        x = log.where("change <> 0").select(F.col(end).alias("node_id"), "i", "change").join(known.select("node_id", "since", degree), "node_id").where("i > since")
        x = x.withColumn("run", F.col(degree) + F.sum("change").over(own))
        return x.groupBy("node_id").agg((F.max_by("run", "i") - F.least(F.lit(0), F.min("run"))).alias(f"new_{degree}"))

    asked = events.where("op = 'query'").select("node_id", "i", "ts").join(known.select("node_id", "since"), "node_id").where("i > since")
    asked = asked.groupBy("node_id").agg(F.max_by("ts", "i").alias("asked_at"), F.count("*").alias("asked"))
    x = known.join(degrees("dst", "in_degree"), "node_id", "left").join(degrees("src", "out_degree"), "node_id", "left").join(asked, "node_id", "left")
    nodes = x.select("node_id", "kind", "added_at", F.coalesce("new_in_degree", "in_degree").alias("in_degree"), F.coalesce("new_out_degree", "out_degree").alias("out_degree"), F.coalesce("asked_at", "last_access").alias("last_access"), (F.col("query_count") + F.coalesce("asked", F.lit(0))).alias("query_count"))
    return Graph(nodes, edges, graph.pins.union(events.where("op = 'pin'").select("node_id")).distinct())


def collected(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without the nodes ``gone`` that aren't pinned, and without their edges, each of which lowers the degree of its other end by one."""
    gone = gone.select("node_id").distinct().join(graph.pins, "node_id", "left_anti")
    source, target = gone.withColumnRenamed("node_id", "src"), gone.withColumnRenamed("node_id", "dst")
    left = graph.edges.join(source, "src", "left_anti").join(target, "dst", "left_anti")
    lost_in = graph.edges.join(source, "src", "left_semi").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("lost_in"))
    lost_out = graph.edges.join(target, "dst", "left_semi").groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("lost_out"))
    nodes = graph.nodes.join(gone, "node_id", "left_anti").join(lost_in, "node_id", "left").join(lost_out, "node_id", "left")
    fewer = lambda degree, lost: F.greatest(F.lit(0), F.col(degree) - F.coalesce(lost, F.lit(0))).alias(degree)
    return Graph(nodes.select("node_id", "kind", "added_at", fewer("in_degree", "lost_in"), fewer("out_degree", "lost_out"), "last_access", "query_count"), left.select("src", "dst", "count"), graph.pins)


def newer_evidence(nodes: DataFrame, edges: DataFrame, t: float, min_age: float = 30 * DAY) -> DataFrame:
    """node_id of facts, episodes and mentions old enough that share an entity with strictly newer evidence: a maximum for each entity, no pairs."""
    evidence = nodes.where(F.col("kind").isin(*EVIDENCE)).select("node_id", "added_at")
    entities = nodes.where("kind = 'entity'").select(F.col("node_id").alias("entity"))
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("entity")).union(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("entity"))).distinct()
    x = both.join(evidence, "node_id").join(entities, "entity")
    newest = x.groupBy("entity").agg(F.max("added_at").alias("newest"))
    return x.join(newest, "entity").where((F.col("added_at") < F.col("newest")) & (F.lit(t) - F.col("added_at") >= min_age)).select("node_id").distinct()


def candidates(graph: Graph, rule: str, t: float, facts: DataFrame | None = None, tenant_pins: DataFrame | None = None, **settings: float) -> DataFrame:
    """node_id of the nodes that a rule collects at time t. ``facts`` adds invalid_at and superseded_by of nodes; ``settings`` go to the rules."""
    pins = graph.pins.withColumn("pinned", F.lit(True))
    x = graph.nodes.join(pins, "node_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    if facts is None:
        x = x.withColumn("invalid_at", F.lit(None).cast("double")).withColumn("superseded_by", F.lit(None).cast("string"))
    else:
        x = x.join(facts.select("node_id", "invalid_at", "superseded_by"), "node_id", "left")
    if tenant_pins is None:
        x = x.withColumn("tenant_pinned", F.lit(False))
    else:
        x = x.join(tenant_pins.select("node_id").distinct().withColumn("tenant_pinned", F.lit(True)), "node_id", "left").withColumn("tenant_pinned", F.coalesce("tenant_pinned", F.lit(False)))
    free = x.where("not pinned")
    if rule == "evidence_count":
        return free.select("node_id").join(newer_evidence(graph.nodes, graph.edges, t), "node_id", "left_semi")
    links = graph.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if rule == "component_isolation":
        return lifecycle.isolated(x, links, t).select("node_id")
    if rule != "bundle":
        return free.where(lifecycle.rules(t, **settings)[rule]).select("node_id")
    # The component must be isolated, and one of the layers must ask for the node.
    single = lifecycle.rules(t, **settings)
    asked = free.where(single["temporal_validity"] | single["activation_decay"] | single["supersession"]).select("node_id").union(newer_evidence(graph.nodes, graph.edges, t))
    alone = lifecycle.isolated(x, links, t).select("node_id")
    return free.where("not tenant_pinned").select("node_id").join(asked, "node_id", "left_semi").join(alone, "node_id", "left_semi")


#: Rules that keep pins by tenant.
BY_TENANT = ("tenant_pin", "comprehensive", "comprehensive_tuned", "bundle")


def routed_pins(events: DataFrame, rule: str) -> tuple[DataFrame, DataFrame]:
    """(events, tenant pins): pins with a tenant_id go to the rule's own table (tenant_id, node_id) if it keeps pins by tenant, and else stay events."""
    own = (F.col("op") == "pin") & F.col("tenant_id").isNotNull() & F.lit(rule in BY_TENANT)
    return events.where(~own), events.where(own).select("tenant_id", "node_id").distinct()


class Run(NamedTuple):
    """What a replay leaves: the graph, tombstones (node_id, collected_at, superseded_by), and counts of the run."""

    graph: Graph
    tombstones: DataFrame
    counts: dict[str, int]


def swept(graph: Graph, rule: str, t: float, facts: DataFrame | None = None, tenant_pins: DataFrame | None = None, **settings: float) -> tuple[Graph, DataFrame]:
    """One sweep: the graph after it, and the tombstones that it writes."""
    gone = reliable(candidates(graph, rule, t, facts, tenant_pins, **settings))
    tombs = gone.withColumn("collected_at", F.lit(float(t)))
    tombs = tombs.withColumn("superseded_by", F.lit(None).cast("string")) if facts is None else tombs.join(facts.select("node_id", "superseded_by"), "node_id", "left")
    after = collected(graph, gone)
    return Graph(stored(after.nodes), stored(after.edges), reliable(after.pins)), reliable(tombs)


def replayed(events: DataFrame, rule: str, every: int, survivors: DataFrame | None = None, facts: DataFrame | None = None, tenant_pins: DataFrame | None = None, pins_first: bool = False, **settings: float) -> Run:
    """The whole log with a sweep after each ``every`` events and one after the last, each on the state that the last left.

    Candidates among ``survivors`` (node_id) count as false collections, once for each
    sweep. ``pins_first`` applies all pins before anything else. i counts from 1.
    """
    ends = events.agg(F.max("i").alias("n"), F.max_by("ts", "i").alias("t")).first()
    graph, tombs, counts = empty(events), None, {"sweeps": 0, "collected": 0, "false_collections": 0}
    if pins_first:
        graph = graph._replace(pins=events.where("op = 'pin'").select("node_id").distinct())
    ticks = [(r["i"], r["ts"]) for r in events.where(F.col("i") % every == 0).select("i", "ts").orderBy("i").collect()]
    if ends["n"] is None:
        return Run(graph, graph.nodes.select("node_id", F.col("added_at").alias("collected_at"), F.lit(None).cast("string").alias("superseded_by")), counts)
    done = 0
    for at, t in [*ticks, (ends["n"], ends["t"])]:
        if at > done:
            graph = applied(graph, events.where((F.col("i") > done) & (F.col("i") <= at)))
            # A sweep reads them several times.
            graph = graph._replace(nodes=stored(graph.nodes), edges=stored(graph.edges))
        graph, fresh = swept(graph, rule, t, facts, tenant_pins, **settings)
        done = at
        counts["sweeps"] += 1
        counts["collected"] += fresh.count()
        if survivors is not None:
            counts["false_collections"] += fresh.join(survivors, "node_id", "left_semi").count()
        tombs = fresh if tombs is None else tombs.union(fresh)
    return Run(graph, tombs, counts)


def survivors_left(run: Run) -> DataFrame:
    """node_id of the entities that are left, in order."""
    return run.graph.nodes.where("kind = 'entity'").select("node_id").orderBy("node_id")


def missing(run: Run, survivors: DataFrame) -> DataFrame:
    """The survivors that aren't left at the end, which a replay through a store counts as false collections."""
    return survivors.join(run.graph.nodes, "node_id", "left_anti")


def superseded_lookup(queries: DataFrame, tombstones: DataFrame, ttl: float = 7 * DAY) -> DataFrame:
    """queries (node_id, asked_at) with the record of a superseded node up to ttl after its collection; one asked for earlier counts too."""
    return queries.join(tombstones.where("superseded_by is not null"), "node_id").where(F.col("asked_at") - F.col("collected_at") <= ttl)


def pruned(tombstones: DataFrame, t: float, ttl: float = 7 * DAY) -> tuple[DataFrame, Column]:
    """The tombstones that are not older than ttl at t, and the count of the others as an aggregate."""
    old = F.lit(t) - F.col("collected_at") > ttl
    return tombstones.where(~old), F.count_if(old).alias("evicted")


def op_counts(events: DataFrame) -> DataFrame:
    """One row with the number of events of each operation."""
    names = ("add_node", "add_edge", "remove_edge", "query", "pin")
    return events.agg(*(F.count_if(F.col("op") == n).alias(n) for n in names), F.count("*").alias("events"))


def from_history(history: DataFrame, hits: DataFrame) -> DataFrame:
    """Nodes of a memory store from its history (node_id, event, ts) and search hits (node_id, ts).

    ADD writes, UPDATE touches and DELETE drops a memory; a hit is a query of one that
    is there at the end. Memories have no edges.
    """
    last = history.groupBy("node_id").agg(F.max_by("event", "ts").alias("last"), F.max_by("ts", F.when(F.col("event") == "ADD", F.col("ts"))).alias("added_at"), F.max(F.when(F.col("event") != "DELETE", F.col("ts"))).alias("touched"))
    asked = hits.groupBy("node_id").agg(F.count("*").alias("asked"), F.max("ts").alias("asked_at"))
    x = last.where("last <> 'DELETE'").join(asked, "node_id", "left")
    return x.select("node_id", F.lit("fact").alias("kind"), "added_at", F.lit(0).cast("long").alias("in_degree"), F.lit(0).cast("long").alias("out_degree"), F.greatest("touched", "asked_at").alias("last_access"), F.coalesce("asked", F.lit(0)).alias("query_count"))


def from_episodes(entities: DataFrame, episodes: DataFrame, mentions: DataFrame, hits: DataFrame) -> Graph:
    """A store of entities and episodes (node_id, ts), mentions (src, dst) and hits on mentions (src, dst, ts): edges are a set, and a hit credits both ends."""
    edges = mentions.select("src", "dst").distinct().withColumn("count", F.lit(1).cast("long"))
    asked = hits.select(F.explode(F.array("src", "dst")).alias("node_id"), "ts").groupBy("node_id").agg(F.count("*").alias("asked"), F.max("ts").alias("asked_at"))
    nodes = entities.select("node_id", F.lit("entity").alias("kind"), "ts").unionByName(episodes.select("node_id", F.lit("fact").alias("kind"), "ts"))
    into = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    out = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    x = nodes.join(into, "node_id", "left").join(out, "node_id", "left").join(asked, "node_id", "left")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    nodes = x.select("node_id", "kind", F.col("ts").alias("added_at"), zero("in_degree", "in_degree"), zero("out_degree", "out_degree"), F.greatest("ts", "asked_at").alias("last_access"), zero("asked", "query_count"))
    return Graph(nodes, edges, nodes.where("false").select("node_id"))


def deletion_order(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The nodes to delete with their place: episodes before entities, by id."""
    x = nodes.join(gone, "node_id", "left_semi").withColumn("first", (F.col("kind") == "entity").cast("int"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("first").orderBy("node_id"))).select("node_id", "kind", "first", "place")


def document_ids(documents: DataFrame, order: str) -> DataFrame:
    """documents with doc_node, a generated id by their place."""
    numbered = lifecycle.numbered(documents.withColumn("_ts", F.col(order).cast("double")), "_ts", order)
    return numbered.withColumn("doc_node", F.format_string("doc_%08d", F.col("i") - 1)).drop("_ts", "i", "day")
