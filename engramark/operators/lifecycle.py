"""Memory-graph lifecycle: node state from the edge log, collection rules, sweeps, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators.graph import connected

DAY = 86400.0


def node_state(edges: DataFrame) -> DataFrame:
    """One row per node of an edge log (fact, entity, at, removed, queried): kind, added_at, degrees, last access, query count.

    The log has no order of its own: an add raises the degree by one, and removals, which
    come after the adds, lower it only where they take the edge's count to zero, and
    then by one. For events in any order there is replay.applied().
    """
    e = edges.groupBy("fact", "entity").agg(F.count("*").alias("n"), F.count_if("removed").alias("r"), F.min("at").alias("at"), F.count_if("queried").alias("q"), F.max(F.when(F.col("queried"), F.col("at"))).alias("last"), F.max(F.when(F.col("removed"), F.col("at"))).alias("gone"))
    degree = F.col("n") - F.when(F.col("r") >= F.col("n"), 1).otherwise(0)

    def side(key: str, kind: str, prefix: str) -> DataFrame:
        x = e.groupBy(F.col(key).alias("num")).agg(F.min("at").alias("added_at"), F.sum(degree).alias("degree"), F.sum("q").alias("query_count"), F.max("last").alias("last_access"), F.max("gone").alias("last_removed"))
        return x.select(F.concat(F.lit(f"{prefix}:"), F.col("num").cast("string")).alias("node_id"), "num", F.lit(kind).alias("kind"), "added_at", F.when(F.lit(kind == "entity"), F.col("degree")).otherwise(0).alias("in_degree"), F.when(F.lit(kind == "fact"), F.col("degree")).otherwise(0).alias("out_degree"), "query_count", "last_access", "last_removed")

    return side("fact", "fact", "o").unionByName(side("entity", "entity", "p"))


def rules(t: float, fact_age: float = DAY, entity_age: float = 7 * DAY, old: float = 14 * DAY, idle: float = 60 * DAY, long: float = 30 * DAY, decay: float = 0.1, floor: float = 0.05, busy: int = 3) -> dict[str, Column]:
    """Whether each rule collects a node at time t; rows have node_state's columns, pinned, tenant_pinned, invalid_at, superseded_by."""
    age = t - F.col("added_at")
    quiet = t - F.coalesce("last_access", "added_at")
    free, tenant_free = ~F.col("pinned"), ~F.col("tenant_pinned")
    fact, entity = F.col("kind") == "fact", F.col("kind") == "entity"
    orphan = free & entity & (age >= entity_age) & (F.col("in_degree") == 0)
    unlinked = free & fact & (age >= fact_age) & (F.col("out_degree") == 0)
    idle_entity = free & entity & (F.col("in_degree") <= 0) & (age >= long) & (quiet >= idle)
    expired = free & F.col("invalid_at").isNotNull() & (t - F.col("invalid_at") >= entity_age)
    # Without an access a node counts as idle since time 0.
    inactive = free & F.col("invalid_at").isNull() & ~((t - F.coalesce("last_access", F.lit(0.0)) < idle) | (F.col("query_count") >= busy))
    replaced = free & F.col("superseded_by").isNotNull() & (age >= fact_age)
    worn = free & entity & (age >= old) & (text.utility(quiet / DAY, F.col("query_count"), decay) < floor)
    tuned = unlinked | (idle_entity & ~(entity & (F.col("query_count") >= busy)))
    never = F.lit(False)
    return {
        "no_gc": never, "ref_count": orphan, "ref_count_utility": orphan | worn, "fact_only": unlinked,
        "conservative_entity": unlinked | idle_entity, "tenant_pin": unlinked & tenant_free, "comprehensive": (unlinked | idle_entity) & tenant_free,
        "tuned": tuned, "comprehensive_tuned": tuned & tenant_free,
        "temporal_validity": F.coalesce(expired, never), "activation_decay": inactive, "supersession": replaced,
    }


def outdated_evidence(facts: DataFrame, edges: DataFrame, t: float, min_age: float = 30 * DAY) -> DataFrame:
    """node_id of facts old enough that share an entity with a strictly newer fact: one window per entity, no self-join."""
    x = edges.select("fact", "entity").distinct().join(facts.select(F.col("num").alias("fact"), "node_id", "added_at", "pinned"), "fact")
    newest = F.max("added_at").over(Window.partitionBy("entity"))
    y = x.withColumn("newest", newest).where((F.col("added_at") < F.col("newest")) & ~F.col("pinned") & (t - F.col("added_at") >= min_age))
    return y.select("node_id").distinct()


def isolated(nodes: DataFrame, links: DataFrame, t: float, idle: float = 30 * DAY, min_age: float = 7 * DAY) -> DataFrame:
    """node_id and component of all members of components without a pin, idle for longer than ``idle`` and at least ``min_age`` old; nodes has node_id, added_at, last_access, pinned."""
    roots = connected(links)
    x = nodes.join(roots, nodes["node_id"] == roots["node"], "left").withColumn("component", F.coalesce("component", "node_id")).drop("node")
    calm = x.groupBy("component").agg(F.bool_or("pinned").alias("pin"), F.max(F.coalesce("last_access", F.lit(0.0))).alias("last"), F.min("added_at").alias("first"))
    calm = calm.where(~F.col("pin") & (t - F.col("last") > idle) & (t - F.col("first") >= min_age))
    return x.join(calm.select("component"), "component").select("node_id", "component")


def numbered(log: DataFrame, ts: str, *ties: str) -> DataFrame:
    """Adds i, the place from 1 in the order of (ts, ties): days are counted, and only the days' counts are summed in one place."""
    day = log.withColumn("day", F.floor(F.col(ts) / DAY))
    before = day.groupBy("day").agg(F.count("*").alias("c")).withColumn("offset", F.sum("c").over(Window.orderBy("day")) - F.col("c"))
    within = F.row_number().over(Window.partitionBy("day").orderBy(ts, *ties))
    return day.withColumn("w", within).join(before.drop("c"), "day").withColumn("i", F.col("w") + F.col("offset")).drop("w", "offset")


def idle_spans(log: DataFrame) -> DataFrame:
    """fact, added_at, i_from, next_i: the stretches of the log in which a fact has no edge; next_i is null for the last.

    log has fact, entity, ts, op (1 add, -1 remove) and i.
    """
    edge = Window.partitionBy("fact", "entity").orderBy("i")
    s = F.sum("op").over(edge)
    clamped = log.withColumn("s", s).withColumn("low", F.least(F.lit(0), F.min("s").over(edge))).withColumn("count", F.col("s") - F.col("low"))
    change = F.when(F.col("op") == 1, 1).when((F.col("op") == -1) & (F.col("count") == 0), -1).otherwise(0)
    own = Window.partitionBy("fact").orderBy("i")
    x = clamped.withColumn("degree", F.sum(change).over(own)).withColumn("next_i", F.lead("i").over(own)).withColumn("added_at", F.min("ts").over(Window.partitionBy("fact")))
    return x.where("degree = 0").select("fact", "added_at", F.col("i").alias("i_from"), "next_i")


def fact_sweeps(log: DataFrame, every: int, min_age: float, spans: DataFrame | None = None) -> DataFrame:
    """fact, added_at, tick, collected_at: the sweep that collects each fact without edges, exact for rules that read only a fact's own edges.

    Sweeps run after every ``every`` events and after the last. A fact is collected at
    the first sweep inside a stretch without edges at which it is old enough; facts
    that none collects have nulls. ``spans`` are idle_spans(log), which don't depend on the sweeps.
    """
    spans = idle_spans(log) if spans is None else spans
    ends = log.agg(F.max("i").alias("last_i"))
    ticks = log.join(F.broadcast(ends)).where((F.col("i") % every == 0) | (F.col("i") == F.col("last_i"))).select(F.col("i").alias("tick"), F.col("ts").alias("tick_ts"), F.col("day").alias("tick_day"))
    facts = log.groupBy("fact").agg(F.min("ts").alias("added_at"))
    # The first sweep at which a fact is old enough: facts and sweeps lie in one order of time, day by day, and the days' first sweeps carry over.
    ripe = facts.select("fact", "added_at", (F.col("added_at") + min_age).alias("t"), F.lit(None).cast("long").alias("tick")).withColumn("day", F.floor(F.col("t") / DAY))
    line = ripe.unionByName(ticks.select(F.lit(None).cast("long").alias("fact"), F.lit(None).cast("double").alias("added_at"), F.col("tick_ts").alias("t"), "tick", F.col("tick_day").alias("day")))
    by_day = line.groupBy("day").agg(F.min("tick").alias("first_tick"))
    by_day = by_day.withColumn("next_tick", F.min("first_tick").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1))).drop("first_tick")
    # From the last to the first, as Spark goes through all rows that follow anew for each row. At equal times the facts come after, as a sweep of that time sees them.
    later = Window.partitionBy("day").orderBy(F.desc("t"), F.col("tick").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ripe = line.withColumn("today", F.min("tick").over(later)).where("tick is null").join(F.broadcast(by_day), "day").select("fact", "added_at", F.coalesce("today", "next_tick").alias("ripe_tick"))
    aligned = spans.drop("added_at").join(ripe, "fact").join(F.broadcast(ends))
    tick = F.greatest(F.least(F.ceil(F.col("i_from") / every) * every, F.col("last_i")), F.col("ripe_tick"))
    found = aligned.withColumn("tick", tick).where(F.col("ripe_tick").isNotNull() & (F.col("next_i").isNull() | (F.col("tick") < F.col("next_i"))))
    first = found.groupBy("fact").agg(F.min("tick").alias("tick"))
    return facts.join(first, "fact", "left").join(ticks.select("tick", F.col("tick_ts").alias("collected_at")), "tick", "left").select("fact", "added_at", "tick", "collected_at")


def tombstone_hit(query: Column, collected: Column, ttl: float = 7 * DAY) -> Column:
    return F.coalesce((collected <= query) & (query - collected <= ttl), F.lit(False))
