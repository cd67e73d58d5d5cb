"""Queries of the simulators; every order is a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.functions.prompts import TEMPLATES, rendered
from engramark.operators import gates
from engramark.operators import simulate as s
from engramark.operators.metrics import percentile_of_counts
from engramark.sources.workloads import table

GOALS = ("find information about topic {}", "process the dataset and report metric {}", "reorganize project files for {}", "notify the team about event {}", "compute the quantity {}", "fetch the current value of datum {}", "say hello to {}")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """task_id, difficulty, category, task_class, goal, required, helpers, failure (null for most), n_steps, fail_step of each order."""
    k = F.col("o_orderkey")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    cats = list(s.TOOLS)
    required = F.array(*(F.element_at(F.element_at(F.array(*(F.array(*map(F.lit, s.TOOLS[c])) for c in cats)), (k % 7 + 1).cast("int")), ((k + j) % 5 + 1).cast("int")) for j in (0, 2)))
    u = text.uniform("kind", k)
    kind = F.when(u < 0.55, "tool_error").when(u < 0.75, "timeout").when(u < 0.90, "validation_failure").otherwise("model_refusal")
    n = (3 + k % 4).cast("int")
    return table(spark, d, "orders").select(
        k.alias("task_id"), (1 + k % 5).cast("int").alias("difficulty"), pick(s.CATEGORIES, k % 5).alias("category"), pick(s.CLASSES, k % 4).alias("task_class"),
        F.replace(pick(GOALS, k % 7), F.lit("{}"), k.cast("string")).alias("goal"), required.alias("required"),
        F.when(k % 3 == 0, F.array(F.element_at(F.array(*(F.lit(s.TOOLS[c][0]) for c in cats)), ((k + 2) % 7 + 1).cast("int")), F.lit("no_such_tool"))).alias("helpers"),
        F.when(text.uniform("fail", k) < 0.3, kind).alias("failure"), n.alias("n_steps"), (1 + k % (n - 2)).cast("int").alias("fail_step"),
    )


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Completion, cost of the rendered prompt, its longest hundredth and variance over categories of each prompt variant."""
    x = tasks(spark, d).join(F.broadcast(s.prompt_table(spark)), ["category", "difficulty"])
    done = (text.uniform("prompt", F.col("prompt"), F.col("task_id")) < F.col("p_prompt")).cast("double")
    size = F.lit(0)
    for variant in s.PROMPT_LIFT:
        size = F.when(F.col("prompt") == variant, F.length(rendered(variant, F.col("goal")))).otherwise(size)
    cost = F.greatest(F.lit(1.0), size / 4) + s.OUTPUT_TOKENS
    by = x.withColumn("cost", cost).groupBy("prompt", "category", "cost").agg(F.count("*").alias("n"), F.sum(done).alias("done"), F.sum("p_prompt").alias("p"))
    p99 = percentile_of_counts(by, "cost", "n", 0.99, "prompt").withColumnRenamed("percentile", "p99")
    by = by.groupBy("prompt", "category").agg(F.sum("n").alias("n"), F.sum("done").alias("done"), F.sum(F.col("cost") * F.col("n")).alias("cost"), F.sum("p").alias("p"))
    y = by.groupBy("prompt").agg(F.sum("n").alias("n"), F.round(100 * F.sum("done") / F.sum("n"), 4).alias("completion_pct"), F.round(F.sum("p") / F.sum("n"), 6).alias("expected"), F.round(F.sum("cost") / F.sum("n"), 4).alias("mean_cost"), F.round(F.var_samp(100 * F.col("done") / F.col("n")), 4).alias("category_variance"))
    return y.join(p99, "prompt")


def policies(spark: SparkSession, d: str) -> DataFrame:
    x = tasks(spark, d).join(F.broadcast(s.policy_table(spark)), ["task_class", "difficulty"])
    done = text.uniform("policy", F.col("policy"), F.col("task_id")) < F.col("p")
    return x.groupBy("policy", "task_class").agg(F.count("*").alias("n"), F.count_if(done).alias("done"), F.round(F.avg("p"), 6).alias("expected"), F.round(F.avg("steps"), 4).alias("mean_steps"))


def policy_runs(spark: SparkSession, d: str) -> DataFrame:
    """Completion, cost of each success, most steps and the 99th percentile of steps of each policy, within the cap."""
    x = tasks(spark, d).join(F.broadcast(s.policy_table(spark)), ["task_class", "difficulty"])
    done = text.uniform("policy", F.col("policy"), F.col("task_id")) < F.col("p")
    by = x.withColumn("steps", F.least(F.col("steps"), F.lit(s.MOST_STEPS))).groupBy("policy", "steps").agg(F.count("*").alias("n"), F.count_if(done).alias("done"))
    p99 = percentile_of_counts(by, "steps", "n", 0.99, "policy").withColumnRenamed("percentile", "p99")
    y = by.groupBy("policy").agg(F.sum("n").alias("n"), F.sum("done").alias("done"), F.sum(F.col("steps") * F.col("n")).alias("total_steps"), F.max("steps").alias("most_steps"))
    return y.join(p99, "policy").select("policy", "n", F.round(100 * F.col("done") / F.col("n"), 4).alias("completion_pct"), F.round(F.col("total_steps") / F.greatest(F.lit(1), F.col("done")), 6).alias("cost_each"), "most_steps", "p99")


def _tool_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tasks counted by all that tool variants look at: the words' categories are found once for each task, tools only for each kind."""
    t = tasks(spark, d).withColumn("found", s.categories_in(F.col("goal"))).withColumn("wide", s.categories_in(F.col("goal"), s.MORE_KEYWORDS))
    tokens = F.greatest(F.lit(1.0), F.length("goal") / 4)
    return t.groupBy("found", "wide", "required", "helpers", "category", "difficulty", "failure").agg(F.count("*").alias("times"), F.sum(tokens).alias("tokens"))


def _shown_tools(kinds: DataFrame) -> DataFrame:
    """kinds with tools, shown (their number) and hit (how many of the required ones), a row for each tool variant."""
    each = s.exposed_tools(F.col("found"), F.col("wide"), F.col("helpers"))
    rows = (F.struct(F.lit(v).alias("tools"), F.size(x).alias("shown"), F.size(F.array_intersect("required", x)).alias("hit")) for v, x in each.items())
    return kinds.withColumn("k", F.size("required")).select("*", F.inline(F.array(*rows)))


def tool_choice(spark: SparkSession, d: str) -> DataFrame:
    """Micro precision and recall, tokens, latency and expected completion of each tool variant: the chance falls with each extra tool."""
    x = _shown_tools(_tool_kinds(spark, d)).withColumn("latency", 1 + 0.05 * F.col("shown"))
    p = F.when(F.col("hit") == F.col("k"), F.pow(F.greatest(F.lit(0.0), 0.95 - 0.005 * (F.col("shown") - F.col("k"))), F.col("k"))).otherwise(0.0)
    total = lambda c: F.sum(c * F.col("times"))
    y = x.groupBy("tools").agg(F.round(100 * total(F.col("hit")) / total(F.col("shown")), 4).alias("precision_pct"), F.round(100 * total(F.col("hit")) / total(F.col("k")), 4).alias("recall_pct"), F.round(total(500 + s.TOKENS_PER_TOOL * F.col("shown")) / F.sum("times"), 4).alias("mean_cost"), F.round(total(p) / F.sum("times"), 6).alias("expected"))
    p99 = percentile_of_counts(x, "latency", "times", 0.99, "tools")
    return y.join(p99.select("tools", F.round("percentile", 4).alias("p99")), "tools")


def recovery(spark: SparkSession, d: str) -> DataFrame:
    """Completion and cost of each recovery variant under each table of chances, by reproducible draws for each attempt."""
    t = tasks(spark, d)
    variants = spark.createDataFrame([(r, v) for r in s.RESOLVE for v in s.RECOVERY], "resolve string, recovery string")
    actions = s.action_table(spark).groupBy("resolve", "recovery", "kind").agg(F.array_sort(F.collect_list(F.struct("attempt", "p", "cost"))).alias("actions"))
    x = t.crossJoin(F.broadcast(variants)).join(F.broadcast(actions.withColumnRenamed("kind", "failure")), ["resolve", "recovery", "failure"], "left")
    tries = F.coalesce("actions", F.expr("cast(array() as array<struct<attempt: int, p: double, cost: double>>)"))
    draw = lambda a: text.uniform("recover", F.col("recovery"), F.col("task_id"), a["attempt"]) < a["p"]
    first = F.array_min(F.transform(F.filter(tries, draw), lambda a: a["attempt"]))
    x = x.withColumn("first", first).withColumn("ok", F.col("failure").isNull() | F.col("first").isNotNull())
    spent = F.aggregate(F.filter(tries, lambda a: F.col("first").isNull() | (a["attempt"] <= F.col("first"))), F.lit(0.0), lambda c, a: c + a["cost"])
    cost = F.when(F.col("ok"), F.col("n_steps")).otherwise(F.col("fail_step") + 1) + F.when(F.col("failure").isNull(), 0.0).otherwise(spent)
    return x.groupBy("resolve", "recovery").agg(F.count("*").alias("n"), F.count_if("ok").alias("done"), F.round(F.avg(cost), 4).alias("mean_cost"))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    """Expected completion and tokens of every prompt, tool and recovery variant together: 72 rows from three small tables of sums."""
    action = spark.createDataFrame([(v, k, *((a[0], s.RESOLVE["optimistic"][a[0]][s.KINDS.index(k)]) if (a := s.recovery_actions(v, k)) else ("abort", 0.0))) for v in s.RECOVERY for k in s.KINDS], "recovery string, failure string, action string, p double")
    variants = spark.createDataFrame([(v,) for v in s.RECOVERY], "recovery string")
    # All variants are applied to kinds of tasks, of which there are few however many the tasks.
    by_tools = _shown_tools(_tool_kinds(spark, d)).groupBy("tools", "shown", "hit", "k", "category", "difficulty", "failure").agg(F.sum("times").alias("times"), F.sum("tokens").alias("tokens"))
    x = by_tools.crossJoin(F.broadcast(variants)).join(F.broadcast(action), ["recovery", "failure"], "left")
    p_rec = F.when(F.col("failure").isNull(), 1.0).otherwise(F.col("p"))
    tokens = F.when(F.col("action") == "retry", s.RETRY_TOKENS).when(F.col("action") == "fallback", s.FALLBACK_TOKENS).otherwise(0.0)
    cost = F.col("tokens") + F.col("times") * (F.col("shown") * s.TOKENS_PER_TOOL + tokens + s.OUTPUT_TOKENS)
    by = x.groupBy("tools", "recovery", "category", "difficulty").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("hit") / F.col("k") * p_rec).alias("pp"), F.sum(cost).alias("cost"))
    y = by.join(F.broadcast(s.prompt_table(spark)), ["category", "difficulty"])
    return y.groupBy("prompt", "tools", "recovery").agg(F.sum("n").alias("n"), F.round(100 * F.sum(F.col("pp") * F.col("p_prompt")) / F.sum("n"), 6).alias("completion_pct"), F.round(F.sum("cost") / F.sum("n"), 4).alias("mean_cost"))


def cross_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return _matrix(spark, d)


def cross_pareto(spark: SparkSession, d: str) -> DataFrame:
    return s.pareto(_matrix(spark, d), "completion_pct", "mean_cost").select("prompt", "tools", "recovery", "completion_pct", "mean_cost")


def cross_rollups(spark: SparkSession, d: str) -> DataFrame:
    """Mean completion by tool, recovery and prompt variant in one pass of grouping sets."""
    _matrix(spark, d).createOrReplaceTempView("_cross_matrix")
    return spark.sql("""
      SELECT CASE WHEN grouping(tools) = 0 THEN 'tools' WHEN grouping(recovery) = 0 THEN 'recovery' ELSE 'prompt' END AS dimension,
             coalesce(tools, recovery, prompt) AS variant, count(*) AS configs, round(avg(completion_pct), 4) AS completion_pct
      FROM _cross_matrix GROUP BY GROUPING SETS ((tools), (recovery), (prompt))""")


def robust_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Whether a recovery variant lifts completion by the gate's points under every table of chances."""
    x = gates.against(recovery(spark, d), "recovery", "abort", ("resolve",))
    lift = 100.0 * F.col("done") / F.col("n") - 100.0 * F.col("base.done") / F.col("base.n")
    return x.groupBy("recovery").agg(F.count("*").alias("tables"), F.count_if(lift >= gates.LIMITS["UC-REC-1"]).alias("passing"), F.bool_and(lift >= gates.LIMITS["UC-REC-1"]).alias("robust"))


def failures_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and share completed without recovery by kind of failure, none being a kind."""
    return tasks(spark, d).groupBy(F.coalesce("failure", F.lit("none")).alias("kind")).agg(F.count("*").alias("n"), F.avg(F.col("failure").isNull().cast("double")).alias("completed"))


def cross_against_base(spark: SparkSession, d: str) -> DataFrame:
    """How many configurations beat, equal and lose to the plain one."""
    m = _matrix(spark, d)
    base = m.where("prompt = 'default' and tools = 'all' and recovery = 'abort'").select(F.col("completion_pct").alias("base"))
    x = m.crossJoin(F.broadcast(base)).withColumn("lift", F.col("completion_pct") - F.col("base"))
    return x.agg(F.count_if(F.col("lift") > 0).alias("beat"), F.count_if(F.col("lift") < 0).alias("lose"), F.count_if(F.col("lift") == 0).alias("equal"))


def cross_best(spark: SparkSession, d: str) -> DataFrame:
    """The ten configurations that complete most, and the five that complete least."""
    m = _matrix(spark, d)
    names = ("prompt", "tools", "recovery")
    best = m.orderBy(F.desc("completion_pct"), *names).limit(10).select(F.lit("best").alias("list"), *names, "completion_pct")
    return best.unionByName(m.orderBy("completion_pct", *names).limit(5).select(F.lit("worst").alias("list"), *names, "completion_pct"))


QUERIES = {f.__name__: f for f in (prompts, policies, policy_runs, tool_choice, recovery, robust_recovery, failures_by_kind, cross_dimensions, cross_pareto, cross_rollups, cross_against_base, cross_best)}


def _values(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join(str(r) for r in rows)}) {names}"


_U = "CAST(('0x' || substr(sha256({}), 1, 8)) AS UBIGINT) / 4294967296.0"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_UNIVERSE = sorted(t for ts in s.TOOLS.values() for t in ts)
_TASKS = f"""task AS (
  SELECT o_orderkey AS task_id, CAST(1 + o_orderkey % 5 AS INT) AS difficulty, {_LIST(s.CATEGORIES)}[o_orderkey % 5 + 1] AS category, {_LIST(s.CLASSES)}[o_orderkey % 4 + 1] AS task_class,
    replace({_LIST(GOALS)}[o_orderkey % 7 + 1], '{{}}', CAST(o_orderkey AS VARCHAR)) AS goal,
    [[{', '.join(_LIST(ts) for ts in s.TOOLS.values())}][o_orderkey % 7 + 1][o_orderkey % 5 + 1], [{', '.join(_LIST(ts) for ts in s.TOOLS.values())}][o_orderkey % 7 + 1][(o_orderkey + 2) % 5 + 1]] AS required,
    CASE WHEN o_orderkey % 3 = 0 THEN [{_LIST([ts[0] for ts in s.TOOLS.values()])}[(o_orderkey + 2) % 7 + 1], 'no_such_tool'] END AS helpers,
    CASE WHEN {_U.format("'fail:' || o_orderkey")} < 0.3 THEN CASE WHEN u < 0.55 THEN 'tool_error' WHEN u < 0.75 THEN 'timeout' WHEN u < 0.90 THEN 'validation_failure' ELSE 'model_refusal' END END AS failure,
    3 + o_orderkey % 4 AS n_steps, 1 + o_orderkey % (1 + o_orderkey % 4) AS fail_step
  FROM (SELECT *, {_U.format("'kind:' || o_orderkey")} AS u FROM orders))"""
_PROMPT = _values([(v, c, d, round(min(1.0, max(0.0, s.BASE[d] + x)), 10)) for v, xs in s.PROMPT_LIFT.items() for c, x in zip(s.CATEGORIES, xs, strict=True) for d in s.BASE], "p(prompt, category, difficulty, p_prompt)")
_POLICY = _values([(v, c, d, round(min(1.0, max(0.0, p * s.PENALTY[d])), 10), s.policy_steps(v, c)) for v, ps in s.POLICY.items() for c, p in zip(s.CLASSES, ps, strict=True) for d in s.PENALTY], "p(policy, task_class, difficulty, p, steps)")
_ACTIONS = _values([(t, v, k, n, table[a][s.KINDS.index(k)], s.ACTION_COST[a]) for t, table in s.RESOLVE.items() for v in s.RECOVERY for k in s.KINDS for n, a in enumerate(s.recovery_actions(v, k), 1)], "a(resolve, recovery, kind, attempt, p, cost)")
_FIRST = _values([(v, k, *((a[0], s.RESOLVE["optimistic"][a[0]][s.KINDS.index(k)]) if (a := s.recovery_actions(v, k)) else ("abort", 0.0))) for v in s.RECOVERY for k in s.KINDS], "f(recovery, failure, action, p)")
_BUDGET = "(SELECT list(t ORDER BY t) FROM (SELECT t FROM (SELECT unnest(" + _LIST(_UNIVERSE) + ") AS t) ORDER BY substr(sha256('42:' || t), 1, 16), t LIMIT 10))"
_KEY = _values([(c, k) for c, ks in s.KEYWORDS.items() for k in ks], "k(category, word)")
_MORE = _values([(c, k) for c, ks in s.MORE_KEYWORDS.items() for k in ks], "k(category, word)")
_SIZES = _values([(v, len(a) + len(b)) for v, (a, b) in TEMPLATES.items()], "z(name, extra)")
_TOOL = _values([(c, t) for c, ts in s.TOOLS.items() for t in ts], "t(category, tool)")
_NEAR = _values([(c, n) for c in s.TOOLS for n in (c, *s.NEIGHBOURS.get(c, ()))], "n(category, near)")
_SHOWN = f"""m AS (SELECT DISTINCT task_id, category AS c FROM (SELECT task_id, goal FROM task) JOIN {_KEY} ON contains(lower(goal), word)),
i1 AS (SELECT task_id, list(DISTINCT tool) AS ts FROM m JOIN {_TOOL} ON t.category = m.c GROUP BY task_id),
w AS (SELECT DISTINCT task_id, category AS c FROM (SELECT task_id, goal FROM task) JOIN {_MORE} ON contains(lower(goal), word)),
i2 AS (SELECT task_id, list(DISTINCT tool) AS ts FROM (
  SELECT task_id, tool FROM w JOIN {_NEAR} ON n.category = w.c JOIN {_TOOL} ON t.category = n.near
  UNION ALL SELECT task_id, unnest(list_intersect(helpers, {_LIST(_UNIVERSE)})) FROM task WHERE helpers IS NOT NULL) GROUP BY task_id),
shown AS (
  SELECT 'all' AS tools, task.*, {_LIST(_UNIVERSE)} AS ts FROM task UNION ALL SELECT 'budget', task.*, {_BUDGET} FROM task
  UNION ALL SELECT 'intent', task.*, coalesce(i1.ts, {_LIST(_UNIVERSE[:10])}) FROM task LEFT JOIN i1 USING (task_id)
  UNION ALL SELECT 'intent_plus', task.*, coalesce(i2.ts, {_LIST(_UNIVERSE[:15])}) FROM task LEFT JOIN i2 USING (task_id)),
sz AS (SELECT *, len(list_intersect(required, ts)) AS hit, len(required) AS k, len(ts) AS n FROM shown)"""
_MATRIX = f"""{_TASKS}, {_SHOWN},
x AS (SELECT sz.*, r.recovery, CASE WHEN sz.failure IS NULL THEN 1.0 ELSE f.p END AS pr, CASE f.action WHEN 'retry' THEN 200.0 WHEN 'fallback' THEN 500.0 ELSE 0.0 END AS tok
  FROM sz CROSS JOIN (SELECT unnest({_LIST(s.RECOVERY)}) AS recovery) r LEFT JOIN {_FIRST} ON f.recovery = r.recovery AND f.failure = sz.failure),
matrix AS (SELECT p.prompt, tools, recovery, count(*) AS n, round(100 * avg(CAST(hit AS DOUBLE) / k * pr * p_prompt), 6) AS completion_pct, round(avg(n * 100.0 + tok + greatest(1.0, length(goal) / 4) + 50), 4) AS mean_cost
  FROM x JOIN {_PROMPT} ON p.category = x.category AND p.difficulty = x.difficulty GROUP BY ALL)"""

SQL = {
    "prompts": f"""
WITH {_TASKS}, x AS (SELECT prompt, t.category, count(*) AS n, count(*) FILTER ({_U.format("'prompt:' || prompt || ':' || task_id")} < p_prompt) AS done, sum(greatest(1.0, (length(goal) + extra) / 4) + 50) AS cost, sum(p_prompt) AS p
  FROM task t JOIN {_PROMPT} ON p.category = t.category AND p.difficulty = t.difficulty JOIN {_SIZES} ON z.name = prompt GROUP BY ALL),
q AS (SELECT prompt, v[CAST(least(len(v) - 1, floor(len(v) * 0.99)) AS BIGINT) + 1] AS p99 FROM (SELECT name AS prompt, list_sort(list(greatest(1.0, (length(goal) + extra) / 4) + 50)) AS v FROM task, {_SIZES} GROUP BY name))
SELECT prompt, any_value(q.p99) AS p99, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(done) / sum(n), 4) AS completion_pct, CAST(round(sum(p) / sum(n), 6) AS DOUBLE) AS expected, CAST(round(sum(cost) / sum(n), 4) AS DOUBLE) AS mean_cost, round(var_samp(100 * done / n), 4) AS category_variance FROM x JOIN q USING (prompt) GROUP BY prompt""",
    "policies": f"""
WITH {_TASKS} SELECT policy, t.task_class, count(*) AS n, count(*) FILTER ({_U.format("'policy:' || policy || ':' || task_id")} < p) AS done, round(avg(p), 6) AS expected, round(avg(steps), 4) AS mean_steps
FROM task t JOIN {_POLICY} ON p.task_class = t.task_class AND p.difficulty = t.difficulty GROUP BY ALL""",
    "tool_choice": f"""
WITH {_TASKS}, {_SHOWN}
SELECT tools, round(100 * sum(hit) / sum(n), 4) AS precision_pct, round(100 * sum(hit) / sum(k), 4) AS recall_pct, round(avg(500 + 100.0 * n), 4) AS mean_cost, round(avg(CASE WHEN hit = k THEN greatest(0.0, 0.95 - 0.005 * (n - k)) ^ k ELSE 0 END), 6) AS expected,
  round(CAST(list_sort(list(1 + 0.05 * n))[CAST(least(count(*) - 1, floor(count(*) * 0.99)) AS BIGINT) + 1] AS DOUBLE), 4) AS p99 FROM sz GROUP BY tools""",
    "policy_runs": f"""
WITH {_TASKS}, x AS (SELECT policy, least(steps, 12) AS steps, {_U.format("'policy:' || policy || ':' || task_id")} < p AS ok FROM task t JOIN {_POLICY} ON p.task_class = t.task_class AND p.difficulty = t.difficulty)
SELECT policy, count(*) AS n, round(100.0 * count(*) FILTER (ok) / count(*), 4) AS completion_pct, round(sum(steps) / greatest(1, count(*) FILTER (ok)), 6) AS cost_each, max(steps) AS most_steps,
  list_sort(list(steps))[CAST(least(count(*) - 1, floor(count(*) * 0.99)) AS BIGINT) + 1] AS p99 FROM x GROUP BY policy""",
    "failures_by_kind": f"WITH {_TASKS} SELECT coalesce(failure, 'none') AS kind, count(*) AS n, CAST(CASE WHEN failure IS NULL THEN 1.0 ELSE 0.0 END AS DOUBLE) AS completed FROM task GROUP BY failure",
    "cross_against_base": f"""WITH {_MATRIX}, b AS (SELECT completion_pct AS base FROM matrix WHERE prompt = 'default' AND tools = 'all' AND recovery = 'abort')
SELECT count(*) FILTER (completion_pct > base) AS beat, count(*) FILTER (completion_pct < base) AS lose, count(*) FILTER (completion_pct = base) AS equal FROM matrix, b""",
    "cross_best": f"""WITH {_MATRIX} SELECT * FROM (SELECT 'best' AS list, prompt, tools, recovery, completion_pct FROM matrix ORDER BY completion_pct DESC, prompt, tools, recovery LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'worst', prompt, tools, recovery, completion_pct FROM matrix ORDER BY completion_pct, prompt, tools, recovery LIMIT 5)""",
    "recovery": f"""
WITH {_TASKS}, v AS (SELECT * FROM (SELECT unnest({_LIST(s.RESOLVE)}) AS resolve), (SELECT unnest({_LIST(s.RECOVERY)}) AS recovery)),
tries AS (SELECT a.*, task_id, {_U.format("'recover:' || a.recovery || ':' || task_id || ':' || attempt")} < p AS hit FROM task JOIN {_ACTIONS} ON a.kind = failure),
f AS (SELECT resolve, recovery, task_id, min(attempt) FILTER (hit) AS first FROM tries GROUP BY ALL),
c AS (SELECT resolve, recovery, task_id, sum(cost) AS spent, any_value(first) AS first FROM tries JOIN f USING (resolve, recovery, task_id) WHERE first IS NULL OR attempt <= first GROUP BY ALL),
x AS (SELECT v.*, task.*, c.first, c.spent, failure IS NULL OR c.first IS NOT NULL AS ok FROM task CROSS JOIN v LEFT JOIN c ON c.resolve = v.resolve AND c.recovery = v.recovery AND c.task_id = task.task_id)
SELECT resolve, recovery, count(*) AS n, count(*) FILTER (ok) AS done, round(avg(CASE WHEN ok THEN n_steps ELSE fail_step + 1 END + coalesce(CAST(spent AS DOUBLE), 0)), 4) AS mean_cost FROM x GROUP BY ALL""",
    "cross_dimensions": f"WITH {_MATRIX} SELECT * FROM matrix",
    "cross_pareto": f"""
WITH {_MATRIX} SELECT prompt, tools, recovery, completion_pct, mean_cost FROM matrix a
WHERE NOT EXISTS (SELECT 1 FROM matrix b WHERE b.completion_pct >= a.completion_pct AND b.mean_cost <= a.mean_cost AND (b.completion_pct > a.completion_pct OR b.mean_cost < a.mean_cost))""",
    "cross_rollups": f"""
WITH {_MATRIX} SELECT 'tools' AS dimension, tools AS variant, count(*) AS configs, round(avg(completion_pct), 4) AS completion_pct FROM matrix GROUP BY tools
UNION ALL SELECT 'recovery', recovery, count(*), round(avg(completion_pct), 4) FROM matrix GROUP BY recovery UNION ALL SELECT 'prompt', prompt, count(*), round(avg(completion_pct), 4) FROM matrix GROUP BY prompt""",
}

SQL["robust_recovery"] = f"""WITH r AS ({SQL['recovery']}), x AS (SELECT r.recovery, 100.0 * r.done / r.n - 100.0 * b.done / b.n >= 5 AS ok FROM r JOIN r b ON b.resolve = r.resolve AND b.recovery = 'abort')
SELECT recovery, count(*) AS tables, count(*) FILTER (ok) AS passing, bool_and(ok) AS robust FROM x GROUP BY recovery"""
