"""Generated workloads as tables: rows come from a range, and every draw from a hash of the seed and the row, so that any engine and any partitioning repeats them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.functions.text import uniform
from engramark.operators.lifecycle import DAY, numbered

EVENT = ("ts", "op", "node_id", "kind", "src", "dst", "tenant_id", "superseded_id")


def weibull(u: Column, shape: float, scale: float) -> Column:
    """A Weibull value from a uniform one; a shape below 1 has a heavy tail."""
    return scale * F.pow(-F.log(1 - u), F.lit(1.0 / shape))


def zipf(u: Column, n: int, exponent: float = 1.0) -> Column:
    """An index from 0 to n - 1 whose frequency falls with its rank, by the number of cumulative shares below a uniform value."""
    weights = [1.0 / (i + 1) ** exponent for i in range(n)]
    total, shares, run = sum(weights), [], 0.0
    for w in weights:
        run += w
        shares.append(run / total)
    return F.least(F.lit(n - 1), F.size(F.filter(F.array(*map(F.lit, shares)), lambda s: s < u)))


def weighted(u: Column, weights: dict[str, float]) -> Column:
    """A key with the chance of its weight over all."""
    total, run, out = sum(weights.values()), 0.0, F.lit(None).cast("string")
    bounds = []
    for key, w in weights.items():
        run += w / total
        bounds.append((key, run))
    out = F.lit(bounds[-1][0])
    for key, bound in reversed(bounds[:-1]):
        out = F.when(u < bound, key).otherwise(out)
    return out


def picked(u: Column, values: tuple) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.least(F.lit(len(values) - 1), F.floor(u * len(values))) + 1).cast("int"))


def _events(df: DataFrame, op: str, ts: Column, **columns: Column) -> DataFrame:
    filled = {c: F.lit(None).cast("string") for c in EVENT[2:]} | columns
    return df.select(ts.cast("double").alias("ts"), F.lit(op).alias("op"), *(filled[c].alias(c) for c in EVENT[2:]))


def _log(parts: list[DataFrame]) -> DataFrame:
    """All parts in the order of time, of equal times in the order of the parts; i counts from 1."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return numbered(out, "ts", "part", "node_id", "src", "dst").drop("part", "day")


def _ids(spark: SparkSession, n: int, pattern: str, name: str = "id") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), F.format_string(pattern, F.col("id")).alias(name))


def chosen(df: DataFrame, n: int, seed: str) -> DataFrame:
    """The n rows with the least draws: a sample without replacement."""
    return df.orderBy(uniform(seed, F.col("k")), "k").limit(n)


def churn(spark: SparkSession, n_entities: int = 20, n_facts: int = 200, lifetime: float = 7 * DAY, pin_fraction: float = 0.1, query_fraction: float = 0.3, edges_per_fact: tuple[int, int] = (1, 3), seed: int = 0, days: float = 30, n_tenants: int = 1, dormant_fraction: float = 0.0, asked_after_fraction: float = 0.0) -> DataFrame:
    """The event log of entities, facts that mention some of them for a lifetime, pins, queries, and queries of facts a day or two after their last edge went."""
    s = lambda name: f"{seed}:{name}"
    entities = _ids(spark, n_entities, "e%04d").withColumn("tenant", F.when(F.lit(n_tenants > 1), F.format_string("tenant_%03d", F.col("k") % n_tenants)))
    pinned = chosen(entities, round(n_entities * pin_fraction), s("pin")).withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)
    dormant = chosen(entities.join(pinned, "id", "left_anti"), round(n_entities * dormant_fraction), s("dormant"))
    start, end = 20.0, days * DAY - lifetime - 100.0
    end = end if end > start else days * DAY - 100.0
    facts = _ids(spark, n_facts, "f%05d").withColumn("at", start + uniform(s("at"), F.col("k")) * (end - start))
    low, high = edges_per_fact
    count = low + F.floor(uniform(s("edges"), F.col("k")) * (high - low + 1))
    # Targets are the entities with the least draws of each fact: different ones.
    ranks = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n_entities - 1)), lambda e: F.struct(uniform(s("to"), F.col("k"), e).alias("u"), e.alias("e"))))
    edges = facts.withColumn("to", F.explode(F.slice(ranks, 1, F.least(count, F.lit(n_entities)).cast("int")))).select("id", "at", F.format_string("e%04d", F.col("to.e")).alias("entity"))
    awake = entities.join(dormant, "id", "left_anti").select("id", "tenant").withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)
    n_awake = awake.count()
    queries = spark.range(int(n_facts * query_fraction) if n_awake else 0).select((start + uniform(s("when"), F.col("id")) * (days * DAY - start)).alias("at"), F.floor(uniform(s("whom"), F.col("id")) * n_awake).cast("int").alias("place")).join(F.broadcast(awake), "place")
    targets = chosen(facts, int(n_facts * asked_after_fraction), s("after"))
    return _log([
        _events(entities, "add_node", F.col("k") * 0.5, node_id=F.col("id"), kind=F.lit("entity"), tenant_id=F.col("tenant")),
        _events(pinned, "pin", 11.0 + F.col("place") * 0.1, node_id=F.col("id"), tenant_id=F.col("tenant")),
        _events(facts, "add_node", F.col("at"), node_id=F.col("id"), kind=F.lit("fact")),
        _events(edges, "add_edge", F.col("at") + 0.001, src=F.col("id"), dst=F.col("entity")),
        _events(edges, "remove_edge", F.col("at") + lifetime, src=F.col("id"), dst=F.col("entity")),
        _events(queries, "query", F.col("at"), node_id=F.col("id")),
        _events(targets, "query", F.col("at") + lifetime + (1 + uniform(s("later"), F.col("k"))) * DAY, node_id=F.col("id")),
    ])


#: What tells the archetypes apart: rate of superseded facts, Zipf exponent of mentions (None: all alike), bursts, and share of facts with very many mentions.
ARCHETYPES = {
    "steady-state": (0.05, None, False, 0.0), "bursty": (0.05, None, True, 0.0), "supersession-heavy": (0.4, None, False, 0.0),
    "cluster-rich": (0.05, 1.0, False, 0.0), "adversarial-no-supersession": (0.0, None, False, 0.0), "large-fact": (0.05, None, False, 0.1),
}


def lifecycle(spark: SparkSession, archetype: str, n_entities: int = 50, n_facts: int = 500, days: float = 30, seed: int = 0) -> DataFrame:
    """The event log of an archetype: facts that mention entities, queries after Weibull waits, and facts that later ones supersede."""
    rate, exponent, bursts, heavy = ARCHETYPES[archetype]
    s = lambda name: f"{archetype}:{seed}:{name}"
    u = lambda name, *xs: uniform(s(name), *(xs or (F.col("k"),)))
    when = u("at") if not bursts else (F.floor(u("burst") * 5) + 0.1 * u("at")) / 5
    facts = _ids(spark, n_facts, "f%06d").withColumn("at", when * days * DAY)
    mentions = F.when(u("heavy") < heavy, 20 + F.floor(u("many") * 30)).otherwise(1 + F.floor(u("few") * 3)).cast("int")
    target = lambda j: zipf(u("to", F.col("k"), j), n_entities, exponent) if exponent else F.floor(u("to", F.col("k"), j) * n_entities).cast("int")
    edges = facts.withColumn("entity", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), mentions), target)))).select("id", "at", F.format_string("e%05d", F.col("entity").cast("long")).alias("entity"), "k")
    asked = facts.where(u("asked") < 0.5).withColumn("t", F.col("at") + weibull(u("wait"), 0.7, 3 * DAY)).where(F.col("t") < days * DAY)
    newer = facts.where((u("old") < rate) & (F.col("k") + 10 < n_facts)).withColumn("by", F.format_string("f%06d", (F.col("k") + 1 + F.floor(u("by") * 9)).cast("long"))).withColumn("t", F.col("at") + 60 + u("soon") * 5 * DAY).where(F.col("t") < days * DAY)
    entities = _ids(spark, n_entities, "e%05d")
    return _log([
        _events(entities, "add_node", F.lit(0.0), node_id=F.col("id"), kind=F.lit("entity")),
        _events(chosen(entities, max(1, n_entities // 20), s("pin")), "pin", F.lit(1.0), node_id=F.col("id")),
        _events(facts, "add_node", F.col("at") + 2, node_id=F.col("id"), kind=F.lit("fact")),
        _events(edges, "add_edge", F.col("at") + 2.001, src=F.col("id"), dst=F.col("entity")),
        _events(asked, "query", F.col("t") + 2, node_id=F.col("id")),
        _events(newer, "supersede", F.col("t") + 2, node_id=F.col("by"), superseded_id=F.col("id")),
    ])


def log_stats(log: DataFrame) -> DataFrame:
    """One row of counts that tell whether a generated log is as asked for."""
    is_ = lambda op, kind=None: F.count_if((F.col("op") == op) & (F.lit(True) if kind is None else F.col("kind") == kind))
    x = log.agg(is_("add_node", "entity").alias("n_entities"), is_("add_node", "fact").alias("n_facts"), is_("query").alias("n_queries"), is_("supersede").alias("n_supersessions"), F.countDistinct(F.when(F.col("op") == "pin", F.col("node_id"))).alias("n_pinned"), F.count("*").alias("total_events"))
    return x.withColumn("supersession_rate", F.col("n_supersessions") / F.greatest(F.lit(1), F.col("n_facts")))


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} replaced one after another."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


#: Kinds of failures and of policy tasks with their weights, and where a task's steps fail.
FAILURES = {"tool_error": 0.55, "timeout": 0.20, "validation_failure": 0.15, "model_refusal": 0.10}
POLICY_CLASSES = {"single_step": 0.30, "multi_step": 0.35, "needs_reflection": 0.20, "needs_replan": 0.15}
DIFFICULTY = {"1": 0.2, "2": 0.25, "3": 0.25, "4": 0.2, "5": 0.1}
TEMPLATES = {
    "reasoning": "If {x} follows from {y}, what comes first?", "extraction": "Extract the entities from {x} and {y}.", "classification": "Is {x} of the kind {y}?",
    "retrieval": "Find what is known of {x} beside {y}.", "code": "Rewrite {x} without {y}.",
}


def failure_tasks(spark: SparkSession, n: int = 100, rate: float = 0.3, min_steps: int = 3, max_steps: int = 7, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """task_id, n_steps, fail_step and kind: at most one failure a task, never at its first or last step."""
    u = lambda name: uniform(f"{seed}:{name}", F.col("k"))
    x = _ids(spark, n, "task_%05d", "task_id").withColumn("n_steps", (min_steps + F.floor(u("steps") * (max_steps - min_steps + 1))).cast("int"))
    fails = (u("fails") < rate) & (F.col("n_steps") > 2)
    return x.withColumn("fail_step", F.when(fails, (1 + F.floor(u("where") * (F.col("n_steps") - 2))).cast("int"))).withColumn("kind", F.when(fails, weighted(u("kind"), weights or FAILURES))).drop("k")


def prompt_tasks(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """task_id, category, difficulty and goal."""
    u = lambda name: uniform(f"{seed}:{name}", F.col("k"))
    x = _ids(spark, n, "task_%05d", "task_id").withColumn("category", picked(u("category"), tuple(TEMPLATES)))
    template = F.create_map(*(F.lit(y) for pair in TEMPLATES.items() for y in pair))[F.col("category")]
    words = {"x": F.format_string("item %d", F.floor(u("x") * 1000)), "y": F.format_string("rule %d", F.floor(u("y") * 1000))}
    return x.withColumn("difficulty", weighted(u("difficulty"), DIFFICULTY).cast("int")).withColumn("goal", filled(template, words)).drop("k")


def policy_tasks(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """task_id, task_class and difficulty."""
    u = lambda name: uniform(f"{seed}:policy:{name}", F.col("k"))
    return _ids(spark, n, "task_%05d", "task_id").select("task_id", weighted(u("class"), POLICY_CLASSES).alias("task_class"), weighted(u("difficulty"), DIFFICULTY).cast("int").alias("difficulty"))


def tool_tasks(spark: SparkSession, n: int = 100, cross_chance: float = 0.3, seed: int = 0) -> DataFrame:
    """task_id, category, required (two tools of it, and one of another category with the chance given) and goal."""
    from engramark.operators.simulate import KEYWORDS, TOOLS

    u = lambda name: uniform(f"{seed}:tool:{name}", F.col("k"))
    names = tuple(TOOLS)
    tools = F.create_map(*(y for c, ts in TOOLS.items() for y in (F.lit(c), F.array(*map(F.lit, ts)))))
    x = _ids(spark, n, "task_%05d", "task_id").withColumn("category", picked(u("category"), names)).withColumn("other", picked(u("other"), names))
    own = tools[F.col("category")]
    first = F.floor(u("first") * 5).cast("int")
    required = F.array_distinct(F.concat(F.array(own[first], own[(first + 1 + F.floor(u("second") * 4).cast("int")) % 5]), F.when(u("cross") < cross_chance, F.array(tools[F.col("other")][F.floor(u("third") * 5).cast("int")])).otherwise(F.expr("cast(array() as array<string>)"))))
    word = F.create_map(*(y for c, ws in KEYWORDS.items() for y in (F.lit(c), F.lit(ws[0]))))[F.col("category")]
    return x.withColumn("required", required).withColumn("goal", F.concat(F.lit("please "), word, F.lit(" item "), F.col("k").cast("string"))).drop("k", "other")


def cross_scenarios(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """Tasks of all dimensions at once: task_id, category, difficulty, goal, required, n_steps, fail_step and kind."""
    tools = tool_tasks(spark, n, seed=seed).select("task_id", "required", F.col("category").alias("tool_category"))
    return prompt_tasks(spark, n, seed).join(tools, "task_id").join(failure_tasks(spark, n, seed=seed), "task_id")


#: Topics of the question corpus.
TOPICS = ("coffee", "engineering", "meetings", "travel", "books", "music", "fitness", "cooking")


def question_corpus(spark: SparkSession, n_memories: int = 200, n_queries: int = 40, aged: float = 0.4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """memories (node_id, topic, text, aged) and queries (query_id, query, topic), whose truth is all memories of the topic."""
    topic = F.element_at(F.array(*map(F.lit, TOPICS)), (F.col("k") % len(TOPICS) + 1).cast("int"))
    memories = _ids(spark, n_memories, "mem_%05d", "node_id").withColumn("topic", topic)
    memories = memories.select("node_id", "topic", F.concat(F.lit("Memory about "), "topic", F.lit(": synthetic content "), F.col("k").cast("string")).alias("text"), (uniform(f"{seed}:aged", F.col("k")) < aged).alias("aged"))
    queries = _ids(spark, n_queries, "q_%05d", "query_id").withColumn("topic", topic)
    return memories, queries.select("query_id", F.concat(F.lit("Tell me about "), "topic").alias("query"), "topic")


def first_contexts(items: DataFrame) -> DataFrame:
    """Questions (seq, context, question, answer) with memory, the number of their context among the different ones in order of first use."""
    first = items.groupBy("context").agg(F.min("seq").alias("first"))
    order = numbered(first.withColumn("ts", F.col("first").cast("double")), "ts", "first").select("context", (F.col("i") - 1).alias("memory"))
    return items.join(order, "context")


def extracted(texts: DataFrame, aliases: dict[str, str], cap: int) -> DataFrame:
    """seq, text, entities (canonicals that the text names as words, in any case, in order) and primary, the first; at most ``cap`` texts of a primary, the earliest, and none without."""
    import re

    either = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)))
    found = F.regexp_extract_all(F.lower("text"), F.lit(rf"(?<![a-z0-9_])({either.lower()})(?![a-z0-9_])"), F.lit(1))
    names = F.create_map(*(F.lit(y) for a, c in aliases.items() for y in (a.lower(), c)))
    x = texts.withColumn("entities", F.array_distinct(F.transform(found, lambda a: names[a]))).where(F.size("entities") > 0).withColumn("primary", F.element_at("entities", 1))
    return x.withColumn("r", F.row_number().over(Window.partitionBy("primary").orderBy("seq"))).where(F.col("r") <= cap).drop("r")


def mention_events(texts: DataFrame, pins: int, lifetime: float) -> DataFrame:
    """The event log of extracted texts (seq, ts, entities): entities when first named, the most frequent pinned (of equals the first named), a fact with its edges for each text, and their removal."""
    x = texts.withColumn("id", F.format_string("t%08d", F.col("seq"))).withColumn("ts", F.col("ts").cast("double"))
    named = x.select("id", "ts", "seq", F.explode("entities").alias("entity"))
    entities = named.groupBy("entity").agg(F.min("ts").alias("first"), F.min("seq").alias("first_seq"), F.count("*").alias("n"))
    top = entities.orderBy(F.desc("n"), "first_seq", "entity").limit(pins)
    return _log([
        _events(entities, "add_node", F.col("first"), node_id=F.col("entity"), kind=F.lit("entity")),
        _events(top, "pin", F.col("first"), node_id=F.col("entity")),
        _events(x, "add_node", F.col("ts"), node_id=F.col("id"), kind=F.lit("fact")),
        _events(named, "add_edge", F.col("ts"), src=F.col("id"), dst=F.col("entity")),
        _events(named, "remove_edge", F.col("ts") + lifetime, src=F.col("id"), dst=F.col("entity")),
    ])


class Registry:
    """Workloads by name: each a function of a session that gives its table. An unknown name is a KeyError that lists the known ones."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, loader: Callable[[SparkSession], DataFrame]) -> None:
        self._loaders[name] = loader

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self._loaders:
            raise KeyError(f"no workload {name!r}; known: {', '.join(self.names())}")
        return self._loaders[name](spark)


def literal_forms(spark: SparkSession, forms: dict[str, dict[str, list[str]]]) -> DataFrame:
    """seq, source_id, input, oracle of forms by source and canonical, in order; strata are looked up by canonical."""
    rows = [(source, form, canonical) for source, by in forms.items() for canonical, xs in by.items() for form in xs]
    return spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "seq long, source_id string, input string, oracle string")


WORKLOADS = Registry()
WORKLOADS.register("churn", churn)
for _name in ARCHETYPES:
    WORKLOADS.register(_name, lambda spark, name=_name: lifecycle(spark, name))
for _f in (failure_tasks, prompt_tasks, policy_tasks, tool_tasks, cross_scenarios):
    WORKLOADS.register(_f.__name__, _f)
