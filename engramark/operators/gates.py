"""Gates: verdicts over one row for each variant, or over a table of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the gates.
LIMITS = {
    "UC-TOOL-1": -5.0, "UC-TOOL-2": 30.0, "UC-TOOL-3": 90.0,
    "UC-PROMPT-1": 5.0, "UC-PROMPT-2": 1.5, "UC-PROMPT-4": 100.0,
    "UC-REC-1": 5.0, "UC-REC-2": 2.0,
    "UC-TOOL-4": 1.5, "UC-PROMPT-3": 2.5, "UC-REC-3": 3.0, "UC-REC-4": 5.0,
    "UC-POLICY-1": 5.0, "UC-POLICY-2": 2.0, "UC-POLICY-3": 12.0, "UC-POLICY-4": 3.0,
    "UC-GC-1": 0.0, "UC-GC-2": 0.95, "UC-GC-3": 1.0, "UC-GC-4": 10.0, "UC-GC-5": 80.0, "UC-GC-RETRIEVAL": 80.0,
    "UC-4.4": 1.0, "UC-4.6": 100.0,
    "null-share": 0.70, "baseline-days": 14, "f1-floor": 75.0,
}


def at_least(gate: str, value: Column) -> Column:
    return _row(gate, value, value >= LIMITS[gate])


def at_most(gate: str, value: Column, places: int = 3) -> Column:
    return _row(gate, value, value <= LIMITS[gate], places)


def below(gate: str, value: Column) -> Column:
    return _row(gate, value, value < LIMITS[gate])


def shown(value: Column, places: int) -> Column:
    """Rounded half to even as values are shown: it is the exact binary value that is rounded, so that 2.675, which is a little less, gives 2.67.

    The product with 10**places is split into what a double holds of it and the exact rest
    (both factors cut into halves whose products are exact), and the rest decides what
    looks like a half.
    """
    scale, cut = float(10**places), float((1 << 27) + 1)
    x = F.abs(value.cast("double"))
    whole = x * scale
    x_high = x * cut - (x * cut - x)
    s_high = scale * cut - (scale * cut - scale)
    x_low, s_low = x - x_high, scale - s_high
    rest = ((x_high * s_high - whole) + x_high * s_low + x_low * s_high) + x_low * s_low
    down = F.floor(whole)
    over = whole - down
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (down % 2 == 1))))
    found = (down + up.cast("long")).cast("double") / scale
    # From 2**52 on there is nothing behind the point.
    return F.when(whole < float(1 << 52), F.when(value < 0, -found).otherwise(found)).otherwise(value.cast("double"))


def _row(gate: str, value: Column, passes: Column, places: int = 3, applies: Column | None = None) -> Column:
    status = F.when(passes, "PASS").otherwise("FAIL")
    status = status if applies is None else F.when(applies, status).otherwise("NA")
    return F.struct(F.lit(gate).alias("gate"), shown(value, places).alias("value"), F.lit(float(LIMITS[gate])).alias("threshold"), status.alias("status"))


def ratio_to(value: Column, base: Column) -> Column:
    """value against base, 1 where the base is 0."""
    return F.when(base > 0, value / base).otherwise(1.0)


def lifecycle_gates(reduction_pct: Column, recall: Column, false_pct: Column, p99_ms: Column, recovered: Column, targets: Column) -> list[Column]:
    """UC-GC-1 to 5; without targets the last does not apply."""
    rate = F.when(targets > 0, 100.0 * recovered / targets).otherwise(0.0)
    return [
        at_least("UC-GC-1", reduction_pct), _row("UC-GC-2", recall, recall >= LIMITS["UC-GC-2"], 4), at_most("UC-GC-3", false_pct), at_most("UC-GC-4", p99_ms, 4),
        _row("UC-GC-5", rate, rate >= LIMITS["UC-GC-5"], 3, targets > 0),
    ]


def retrieval_gate(f1_before: Column, f1_after: Column) -> Column:
    """UC-GC-RETRIEVAL: the part of F1 that a sweep preserves; it does not apply where F1 was 0."""
    kept = F.when(f1_before > 0, 100.0 * f1_after / f1_before).otherwise(0.0)
    return _row("UC-GC-RETRIEVAL", kept, kept >= LIMITS["UC-GC-RETRIEVAL"], 2, f1_before > 0)


def policy_gates(completion: Column, cost_each: Column, most_steps: Column, p99: Column, base: dict[str, Column]) -> list[Column]:
    return [at_least("UC-POLICY-1", completion - base["completion"]), at_most("UC-POLICY-2", ratio_to(cost_each, base["cost_each"])), at_most("UC-POLICY-3", most_steps), at_most("UC-POLICY-4", ratio_to(p99, base["p99"]))]


def pipeline_decision(tests: DataFrame, tier: str, *by: str) -> DataFrame:
    """decision and reasons over rows (type, outcome): none passes; else the fast tier blocks and the nightly one opens a regression."""
    unclear = F.lit(tier == "fast") & F.bool_or(F.col("outcome") == "INCONCLUSIVE")
    worse = F.bool_or(F.col("outcome") == "REGRESSION")
    killed = F.bool_or((F.col("type") == "guardrail_kill_switch") & (F.col("outcome") == "FAIL"))
    reasons = F.array_compact(F.array(F.when(unclear, "inconclusive"), F.when(worse, "regression"), F.when(killed, "kill switch")))
    x = tests.groupBy(*by).agg(reasons.alias("reasons"))
    blocked = "BLOCK_PR" if tier == "fast" else "SOFT_REGRESSION_OPENED"
    return x.withColumn("decision", F.when(F.size("reasons") > 0, blocked).otherwise("PASS_AND_MERGE"))


# Order of verdicts.
VERDICTS = ("FUND-NOW", "FUND-Q+1", "DEFER", "INSUFFICIENT-DATA", "DO-NOT-BUILD")
#: Half width of an interval that was not given, as a part of the lift.
DEFAULT_INTERVAL = 0.15


def build_verdicts(lifts: DataFrame) -> DataFrame:
    """lifts (variant, lift, low, high, weeks, note) with low and high filled in, per_week and verdict, best first.

    A verdict rests on the lower end of the interval; an interaction note may defer or forbid.
    """
    lift, note = F.col("lift"), F.lower(F.coalesce("note", F.lit("")))
    x = lifts.withColumn("low", F.coalesce("low", lift - F.abs(lift) * DEFAULT_INTERVAL)).withColumn("high", F.coalesce("high", lift + F.abs(lift) * DEFAULT_INTERVAL))
    low, weeks = F.col("low"), F.col("weeks")
    either = lambda words: F.contains(note, F.lit(words[0])) | F.contains(note, F.lit(words[1]))
    verdict = (
        F.when(lift <= 0, "DO-NOT-BUILD").when(weeks.isNull(), "INSUFFICIENT-DATA").when(either(("do not deploy", "cross-dim still loses")), "DO-NOT-BUILD")
        .when(F.contains(note, F.lit("superseded by")) | either(("conditional", "fails uc")), "DEFER")
        .when((low >= 5) & (weeks <= 2), "FUND-NOW").when((low >= 10) & (weeks <= 5), "FUND-Q+1").otherwise("DEFER")
    )
    per_week = F.when(weeks > 0, F.greatest(F.lit(0.0), low) / weeks)
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return x.withColumn("per_week", per_week).withColumn("verdict", verdict).orderBy(rank, F.desc(F.coalesce("per_week", F.lit(0.0))), "variant")


def dimension_of(variant: Column) -> Column:
    """The dimension that a variant's name belongs to: the first rule that fits."""
    rules = {
        "memory (canonicalization)": (("embed-proxy",), "b-raw-identity"), "memory (lifecycle)": (("gc-", "b-raw-no-gc"), None), "prompt": (("prompt-",), "b-default-prompt"),
        "tools": (("tool-",), "b-allow-all-tools"), "execution policy": (("policy-", "single-shot"), None), "recovery": (("recovery-", "abort-on-failure"), None),
    }
    found = F.lit("unknown")
    for name, (parts, whole) in reversed(rules.items()):
        on = F.lit(False) if whole is None else variant == whole
        for part in parts:
            on = on | F.contains(variant, F.lit(part))
        found = F.when(on, name).otherwise(found)
    return found


def sweep_ranking(results: DataFrame) -> DataFrame:
    """results (variant, reduction_pct, preservation_pct) by most reduction, then most preserved, with a verdict."""
    kept = F.col("preservation_pct")
    return results.withColumn("verdict", F.when(kept >= 95, "EXCELLENT").when(kept >= 80, "ACCEPTABLE").otherwise("POOR")).orderBy(F.desc("reduction_pct"), F.desc("preservation_pct"), "variant")


def against(results: DataFrame, variant: str, baseline: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each row with the baseline's as struct ``base``; ``by`` are columns that both share. The baseline is one row for each of them."""
    base = results.where(F.col(variant) == baseline).select(*by, F.struct("*").alias("base"))
    return results.join(F.broadcast(base), list(by)) if by else results.crossJoin(F.broadcast(base))


def gate_rows(df: DataFrame, keys: tuple[str, ...], gates: list[Column]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*gates)))


def cost_ratio(cost: Column, done: Column, base_cost: Column, base_done: Column) -> Column:
    """Cost for each success (each variant counts one at least) against the baseline's. If that is 0: 0 for a variant that succeeds, else infinite."""
    own, base = cost / F.greatest(F.lit(1), done), base_cost / F.greatest(F.lit(1), base_done)
    return F.when(base > 0, own / base).when(done > 0, 0.0).otherwise(F.lit(float("inf")))


def inconclusive_fails(outcomes: DataFrame, tier: str) -> DataFrame:
    """passed, n: on the fast tier no row of ``outcome`` may be INCONCLUSIVE. An empty table passes."""
    n = F.count_if(F.col("outcome") == "INCONCLUSIVE")
    return outcomes.agg((F.lit(tier != "fast") | (n == 0)).alias("passed"), n.alias("n"))


def null_share_ok(history: DataFrame) -> DataFrame:
    """passed, mean: the mean of ``null_share`` is at most its limit. No history passes."""
    mean = F.avg("null_share")
    return history.agg(F.coalesce(mean <= LIMITS["null-share"], F.lit(True)).alias("passed"), mean.alias("mean"))


def baseline_fresh(artifacts: DataFrame, now: Column) -> DataFrame:
    """``artifacts`` with passed: the time in JSON column ``body``, of either layout, is at most the limit of days before ``now``. Without a time it fails."""
    found = F.coalesce(F.get_json_object("body", "$.artifact_metadata.timestamp_utc"), F.get_json_object("body", "$.timestamp_utc"))
    age = now.cast("timestamp").cast("double") - F.try_to_timestamp(found).cast("double")
    return artifacts.withColumn("passed", F.coalesce(age <= LIMITS["baseline-days"] * 86400, F.lit(False)))


def f1_floor(results: DataFrame) -> DataFrame:
    """``results`` with passed: preservation_pct is at least the floor, or reduction_pct is 0 as the sweep did nothing."""
    return results.withColumn("passed", (F.col("reduction_pct") == 0) | (F.coalesce("preservation_pct", F.lit(0.0)) >= LIMITS["f1-floor"]))
