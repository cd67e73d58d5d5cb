"""Prompt templates, and the cleaning of what a model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands before and after a task's text, and the examples of the few-shot prompts.
THINK, WORK = "Think step-by-step before answering.\n\nQuestion: ", "\n\nLet's work through this carefully.\n\n"
AS_JSON = '\n\nRespond as JSON with the shape:\n  {"answer": "..."}'
EXAMPLES = (
    ('Extract the entities from: "Apple Inc reported Q3 earnings."', "Apple Inc, Q3, earnings"),
    ("What is the next step in the deployment process?", "Run the smoke tests after rollout."),
    ('Is the sentiment of "Great product, terrible support" positive or negative?', "Mixed - positive on product, negative on support."),
)
EXAMPLES_HEAD, EXAMPLES_TAIL = "Here are some examples:\n", "\nNow answer this:\n"


def examples(n: int) -> str:
    shown = [f"Q: {q}\nA: {a}\n" for q, a in EXAMPLES[:n]]
    return "\n".join([EXAMPLES_HEAD, *shown, EXAMPLES_TAIL])


#: (before, after) of each prompt variant.
TEMPLATES = {
    "default": ("", ""), "cot": (THINK, WORK), "direct_structured": ("", AS_JSON), "few_shot_1": (examples(1), ""), "few_shot_3": (examples(3), ""),
    "cot_plus_structured": (THINK, WORK + AS_JSON),
}


def rendered(variant: str, goal: Column) -> Column:
    before, after = TEMPLATES[variant]
    return F.concat(F.lit(before), F.coalesce(goal, F.lit("")), F.lit(after))


#: Characters that are stripped off an answer, and what stands for none.
STRIPPED, NO_ANSWER = "\"'.,;: \t", "<EMPTY>"


def first_line(answer: Column) -> Column:
    """The first line of an answer without quotes and punctuation around it."""
    line = F.trim(F.split(F.regexp_replace(answer, r"^\s+|\s+$", ""), "\n", 2)[0])
    inside = F.btrim(line, F.lit(STRIPPED))
    return F.when(inside == "", NO_ANSWER).otherwise(inside)
