"""Queries of gates over the simulators' results, and of keyword retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.operators import gates, postings
from engramark.plans import simulation
from engramark.sources.workloads import table

#: The stated questions, and the words that none is searched by (fixed values).
QUESTIONS = ("Tell me about red gear", "show any small ring", "what is a bolt", "blue widget for me", "tell me about the")
STOPWORDS = ("tell", "me", "about", "what", "is", "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "show", "any", "give")
TOP = 20


def tool_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each tool variant against all tools, by expected completion."""
    x = gates.against(simulation.tool_choice(spark, d), "tools", "all")
    lift = 100 * (F.col("expected") - F.col("base.expected"))
    return gates.gate_rows(x, ("tools",), [gates.at_least("UC-TOOL-1", lift), gates.at_least("UC-TOOL-2", F.col("precision_pct")), gates.at_least("UC-TOOL-3", F.col("recall_pct")), gates.at_most("UC-TOOL-4", gates.ratio_to(F.col("p99"), F.col("base.p99")))])


def prompt_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each prompt variant against the plain prompt."""
    x = gates.against(simulation.prompts(spark, d), "prompt", "default")
    lift = F.col("completion_pct") - F.col("base.completion_pct")
    spread = F.col("category_variance") - F.col("base.category_variance")
    return gates.gate_rows(x, ("prompt",), [gates.at_least("UC-PROMPT-1", lift), gates.at_most("UC-PROMPT-2", F.col("mean_cost") / F.col("base.mean_cost")), gates.at_most("UC-PROMPT-3", gates.ratio_to(F.col("p99"), F.col("base.p99"))), gates.at_most("UC-PROMPT-4", spread)])


def policy_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each policy against a single shot."""
    x = gates.against(simulation.policy_runs(spark, d), "policy", "single_shot")
    base = {"completion": F.col("base.completion_pct"), "cost_each": F.col("base.cost_each"), "p99": F.col("base.p99")}
    return gates.gate_rows(x, ("policy",), gates.policy_gates(F.col("completion_pct"), F.col("cost_each"), F.col("most_steps"), F.col("p99"), base))


def recovery_gates(spark: SparkSession, d: str) -> DataFrame:
    """Gates of each recovery variant against giving up, under each table of chances."""
    x = gates.against(simulation.recovery(spark, d), "recovery", "abort", ("resolve",))
    lift = 100.0 * F.col("done") / F.col("n") - 100.0 * F.col("base.done") / F.col("base.n")
    ratio = gates.cost_ratio(F.col("mean_cost") * F.col("n"), F.col("done"), F.col("base.mean_cost") * F.col("base.n"), F.col("base.done"))
    return gates.gate_rows(x, ("resolve", "recovery"), [gates.at_least("UC-REC-1", lift), gates.at_most("UC-REC-2", ratio)])


def keyword_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The first TOP parts, in order, whose names hold a word of each stated question; a question of stopwords finds none."""
    words = lambda q: [w for w in q.lower().split() if w not in STOPWORDS and len(w) > 1]
    hits = [F.when(F.exists(F.array(*map(F.lit, words(q))), lambda w: F.contains(F.lower("p_name"), w)), F.lit(k)) for k, q in enumerate(QUESTIONS) if words(q)]
    found = table(spark, d, "part").select("p_partkey", F.explode(F.array_compact(F.array(*hits))).alias("question"))
    first = F.row_number().over(Window.partitionBy("question").orderBy("p_partkey"))
    return found.select("question", "p_partkey", first.alias("r")).where(F.col("r") <= TOP)


def indexed_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """The first TOP turns that hold a content word of each benchmark item, by the positional index; turns come by conversation and turn."""
    c = table(spark, d, "conversations")
    texts = c.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), "text").groupBy("id", "seq").agg(F.min("text").alias("text"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.col("text").alias("body"))
    return postings.retrieved(items, texts, tuple(STOPWORDS), TOP).select("question", F.col("id").alias("turn_id"), "r")


QUERIES = {f.__name__: f for f in (indexed_retrieval, tool_gates, prompt_gates, policy_gates, recovery_gates, keyword_retrieval)}


def _unpivot(keys: str, columns: dict[str, tuple[str, str]], source: str) -> str:
    one = "SELECT {keys}, '{g}' AS gate, round_even(CAST({v} AS DOUBLE), 3) AS value, CAST({t} AS DOUBLE) AS threshold, CASE WHEN {v} {op} {t} THEN 'PASS' ELSE 'FAIL' END AS status FROM {source}"
    return " UNION ALL ".join(one.format(keys=keys, g=g, v=v, op=op, t=gates.LIMITS[g], source=source) for g, (v, op) in columns.items())


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_QUESTIONS = ", ".join(f"({k}, '{q}')" for k, q in enumerate(QUESTIONS))
SQL = {
    "indexed_retrieval": f"""WITH t AS (SELECT conv_id * 100000 + turn AS id, lower(min(text)) AS body FROM conversations GROUP BY 1),
w AS (SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(string_split_regex(lower(text), '\\s+')) AS word FROM benchmark) WHERE length(word) > 1 AND word NOT IN ({_STOP})),
h AS (SELECT DISTINCT item_id, id FROM w JOIN t ON contains(body, word))
SELECT item_id AS question, id AS turn_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY id) AS INT) AS r FROM h QUALIFY r <= {TOP}""",
    "tool_gates": f"WITH r AS ({simulation.SQL['tool_choice']}), x AS (SELECT r.*, 100 * (r.expected - b.expected) AS lift, r.p99 / b.p99 AS slow FROM r, r b WHERE b.tools = 'all') "
    + _unpivot("tools", {"UC-TOOL-1": ("lift", ">="), "UC-TOOL-2": ("precision_pct", ">="), "UC-TOOL-3": ("recall_pct", ">="), "UC-TOOL-4": ("slow", "<=")}, "x"),
    "prompt_gates": f"""WITH r AS ({simulation.SQL['prompts']}), x AS (
  SELECT r.prompt, r.completion_pct - b.completion_pct AS lift, r.mean_cost / b.mean_cost AS ratio, r.category_variance - b.category_variance AS spread, r.p99 / b.p99 AS slow FROM r, r b WHERE b.prompt = 'default') """
    + _unpivot("prompt", {"UC-PROMPT-1": ("lift", ">="), "UC-PROMPT-2": ("ratio", "<="), "UC-PROMPT-3": ("slow", "<="), "UC-PROMPT-4": ("spread", "<=")}, "x"),
    "policy_gates": f"""WITH r AS ({simulation.SQL['policy_runs']}), x AS (
  SELECT r.policy, r.completion_pct - b.completion_pct AS lift, r.cost_each / b.cost_each AS ratio, r.most_steps AS most, r.p99 / b.p99 AS slow FROM r, r b WHERE b.policy = 'single_shot') """
    + _unpivot("policy", {"UC-POLICY-1": ("lift", ">="), "UC-POLICY-2": ("ratio", "<="), "UC-POLICY-3": ("most", "<="), "UC-POLICY-4": ("slow", "<=")}, "x"),
    "recovery_gates": f"""WITH r AS ({simulation.SQL['recovery']}), x AS (
  SELECT r.resolve, r.recovery, 100.0 * r.done / r.n - 100.0 * b.done / b.n AS lift, (r.mean_cost * r.n / greatest(1, r.done)) / (b.mean_cost * b.n / greatest(1, b.done)) AS ratio
  FROM r JOIN r b ON b.resolve = r.resolve AND b.recovery = 'abort') """
    + _unpivot("resolve, recovery", {"UC-REC-1": ("lift", ">="), "UC-REC-2": ("ratio", "<=")}, "x"),
    "keyword_retrieval": f"""WITH q AS (SELECT * FROM (VALUES {_QUESTIONS}) v(question, body)),
w AS (SELECT DISTINCT question, word FROM (SELECT question, unnest(string_split(lower(body), ' ')) AS word FROM q) WHERE length(word) > 1 AND word NOT IN ({_STOP})),
h AS (SELECT DISTINCT question, p_partkey FROM w JOIN part ON contains(lower(p_name), word))
SELECT CAST(question AS INT) AS question, p_partkey, CAST(row_number() OVER (PARTITION BY question ORDER BY p_partkey) AS INT) AS r FROM h QUALIFY r <= {TOP}""",
}
