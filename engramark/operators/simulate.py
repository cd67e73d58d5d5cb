"""Simulators of prompt, tool, policy and recovery choices: lookups, closed forms and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a variant adds to completion, by task category.
CATEGORIES = ("reasoning", "extraction", "classification", "retrieval", "code")
PROMPT_LIFT = {
    "default": (0.0, 0.0, 0.0, 0.0, 0.0),
    "cot": (0.18, 0.03, 0.04, 0.02, 0.10),
    "direct_structured": (-0.02, 0.10, 0.08, 0.05, 0.02),
    "few_shot_1": (0.06, 0.10, 0.12, 0.04, 0.05),
    "few_shot_3": (0.10, 0.16, 0.18, 0.06, 0.08),
    "cot_plus_structured": (0.16, 0.13, 0.11, 0.05, 0.11),
}
# Completion by difficulty, and the factor that difficulty has on policies.
BASE = {1: 0.85, 2: 0.72, 3: 0.55, 4: 0.40, 5: 0.25}
PENALTY = {1: 1.10, 2: 1.00, 3: 0.95, 4: 0.85, 5: 0.70}
# Completion of policies by task class.
CLASSES = ("single_step", "multi_step", "needs_reflection", "needs_replan")
POLICY = {
    "single_shot": (0.80, 0.30, 0.20, 0.10),
    "react": (0.85, 0.70, 0.40, 0.30),
    "plan_execute": (0.80, 0.75, 0.35, 0.55),
    "reflect_loop": (0.80, 0.70, 0.75, 0.50),
    "handoff": (0.85, 0.55, 0.50, 0.35),
}
# Chance that an action resolves a failure, by kind of failure.
KINDS = ("tool_error", "timeout", "validation_failure", "model_refusal")
RESOLVE = {
    "optimistic": {"retry": (0.70, 0.50, 0.30, 0.10), "fallback": (0.45, 0.65, 0.85, 0.60)},
    "pessimistic": {"retry": (0.35, 0.25, 0.15, 0.05), "fallback": (0.32, 0.45, 0.60, 0.42)},
    "small-model": {"retry": (0.55, 0.40, 0.20, 0.05), "fallback": (0.45, 0.60, 0.80, 0.85)},
    "large-model": {"retry": (0.75, 0.55, 0.35, 0.12), "fallback": (0.45, 0.65, 0.85, 0.20)},
    "hostile": {"retry": (0.20, 0.15, 0.10, 0.03), "fallback": (0.20, 0.30, 0.40, 0.30)},
}
# Steps at most, and costs.
MOST_STEPS = 12
ACTION_COST = {"retry": 1.0, "fallback": 2.5}
TOKENS_PER_TOOL, OUTPUT_TOKENS, RETRY_TOKENS, FALLBACK_TOKENS = 100.0, 50.0, 200.0, 500.0
# Tools by category, words that point to a category, and categories used together.
TOOLS = {
    "search": ("web_search", "doc_search", "code_search", "image_search", "video_search"),
    "data": ("sql_query", "csv_read", "json_parse", "yaml_parse", "xml_parse"),
    "files": ("file_read", "file_write", "file_list", "file_delete", "file_move"),
    "communication": ("send_email", "send_slack", "post_tweet", "send_sms", "schedule_meeting"),
    "computation": ("calculator", "matrix_solve", "regression", "statistics", "unit_convert"),
    "external_api": ("weather", "stock_price", "currency_rate", "geocode", "translate"),
    "system": ("bash_exec", "git_status", "process_list", "memory_info", "disk_info"),
}
KEYWORDS = {
    "search": ("find", "search", "look up", "lookup", "information", "topic"),
    "data": ("process", "dataset", "metric", "data", "query", "report"),
    "files": ("file", "reorganize", "project", "directory"),
    "communication": ("notify", "team", "event", "message", "send"),
    "computation": ("compute", "calculate", "quantity", "math", "solve"),
    "external_api": ("look up", "current", "value", "datum", "fetch"),
    "system": ("inspect", "system", "resource", "process"),
}
# More words for the variant that also shows neighbours and helpers.
MORE_KEYWORDS = {
    "search": ("find", "search", "look up", "lookup", "information", "topic", "discover", "locate", "research", "browse", "query"),
    "data": ("process", "dataset", "metric", "data", "query", "report", "analyze", "aggregate", "summarize", "table", "record", "statistics", "csv", "json", "structured"),
    "files": ("file", "files", "reorganize", "project", "directory", "folder", "path", "save", "load", "read", "write", "list", "filesystem"),
    "communication": ("notify", "team", "event", "message", "send", "alert", "email", "slack", "chat", "post", "broadcast", "tell", "inform", "share"),
    "computation": ("compute", "calculate", "quantity", "math", "solve", "matrix", "regression", "convert", "sum", "total", "value", "estimate", "result"),
    "external_api": ("look up", "current", "value", "datum", "fetch", "weather", "stock", "price", "rate", "translate", "external", "api", "service", "now"),
    "system": ("inspect", "system", "resource", "process", "exec", "shell", "memory", "disk", "git", "status", "info", "diagnostic", "health"),
}
NEIGHBOURS = {"search": ("data",), "data": ("search", "computation"), "files": ("system",), "computation": ("data",), "external_api": ("search",), "system": ("files",)}


def policy_steps(variant: str, task_class: str) -> int:
    """Steps that a policy takes, the finishing one included: fixed by variant and class."""
    single = task_class == "single_step"
    if variant == "react":
        return 6 if single else 7
    if variant == "plan_execute":
        return 2 + {"single_step": 1, "needs_replan": 4}.get(task_class, 3)
    if variant == "reflect_loop":
        return 5 if single else 9
    return 2 if variant == "handoff" else 1


def recovery_actions(variant: str, kind: str) -> list[str]:
    """The actions that a variant takes on a failure until it gives up."""
    retryable = kind in ("tool_error", "timeout")
    if variant == "retry":
        return ["retry"] * 3 if retryable else []
    if variant == "fallback":
        return ["retry"] * 2 * retryable + ["fallback"]
    return []


RECOVERY = ("abort", "retry", "fallback")


def prompt_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, c, d, min(1.0, max(0.0, BASE[d] + x))) for v, xs in PROMPT_LIFT.items() for c, x in zip(CATEGORIES, xs, strict=True) for d in BASE], "prompt string, category string, difficulty int, p_prompt double")


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, c, d, min(1.0, max(0.0, p * PENALTY[d])), policy_steps(v, c)) for v, ps in POLICY.items() for c, p in zip(CLASSES, ps, strict=True) for d in PENALTY], "policy string, task_class string, difficulty int, p double, steps int")


def action_table(spark: SparkSession) -> DataFrame:
    """resolve, recovery, kind, attempt, action, p: the actions in order; abort alone has none."""
    rows = [(t, v, k, n, a, table[a][KINDS.index(k)], ACTION_COST[a]) for t, table in RESOLVE.items() for v in RECOVERY for k in KINDS for n, a in enumerate(recovery_actions(v, k), 1)]
    return spark.createDataFrame(rows, "resolve string, recovery string, kind string, attempt int, action string, p double, cost double")


def categories_in(goal: Column, words: dict[str, tuple[str, ...]] = KEYWORDS) -> Column:
    """Categories whose words stand in a goal."""
    text = F.lower(goal)
    hits = [F.when(F.expr("false"), F.lit(None).cast("string"))]
    for category, keywords in words.items():
        on = F.lit(False)
        for k in keywords:
            on = on | F.contains(text, F.lit(k))
        hits.append(F.when(on, F.lit(category)))
    return F.array_compact(F.array(*hits))


def exposed_tools(found: Column, wide: Column, helpers: Column | None = None, seed: str = "42") -> dict[str, Column]:
    """Tools that each variant shows: all, a hashed ten, those of the categories ``found``, and those of ``wide`` (found by more words) with neighbours and the task's helpers."""
    universe = sorted(t for ts in TOOLS.values() for t in ts)
    import hashlib

    budget = sorted(universe, key=lambda t: (hashlib.sha256(f"{seed}:{t}".encode()).hexdigest()[:16], t))[:10]
    of = F.create_map(*(x for c, ts in TOOLS.items() for x in (F.lit(c), F.array(*map(F.lit, ts)))))
    near = F.create_map(*(x for c in TOOLS for x in (F.lit(c), F.array(*map(F.lit, (c, *NEIGHBOURS.get(c, ())))))))
    every = F.array(*map(F.lit, universe))

    def tools(categories: Column, fallback: int, more: Column | None = None) -> Column:
        found = F.flatten(F.transform(categories, lambda c: of[c]))
        found = found if more is None else F.concat(found, F.array_intersect(F.coalesce(more, F.expr("cast(array() as array<string>)")), every))
        return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(*map(F.lit, universe[:fallback])))

    with_near = F.array_distinct(F.flatten(F.transform(wide, lambda c: near[c])))
    return {"all": every, "budget": F.array(*map(F.lit, sorted(budget))), "intent": tools(found, 10), "intent_plus": tools(with_near, 15, helpers)}


def call_allowed(tool: Column, seen: Column) -> Column:
    """The veto hook of tool variants: none of them refuses a call."""
    return F.lit(True) | tool.isNull() | seen.isNull()


def pareto(df: DataFrame, gain: str, cost: str) -> DataFrame:
    """Rows that no other beats: at least as much gain for at most the cost, one of them strictly. A running maximum over falling cost, no pairs."""
    from pyspark.sql import Window

    best = df.groupBy(cost).agg(F.max(gain).alias("_best"))
    cheaper = Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("_before", F.max("_best").over(cheaper)).where(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    return df.join(front, cost).where(F.col(gain) == F.col("_best")).drop("_best", "_before")
