"""From documents to packed training sequences: five stages, each over all that the one before kept.

A stage is a function of (spark, docs, sf_dir); its result is to be written before
the next stage over the same folder is called, as run() does: a stage first removes
the tables of the stage before. All but the last return the columns of
``documents``. Every stage gives no rows for an empty table, treats repeated rows
alike (near_dedup keeps or drops them together), and leaves other columns as they are.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import scratch
from engramark.llm.decontaminate import contamination
from engramark.llm.language import identify, learn
from engramark.llm.near_dedup import near_duplicates
from engramark.llm.packing import pack
from engramark.llm.suffix_dedup import PASSAGE, without_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _owner(sf_dir: str, name: str) -> str:
    return f"pipeline {sf_dir} {name}"


def stage(before: str | None) -> Callable[[Stage], Stage]:
    """Gives a stage's tables an owner, and removes those of the stage ``before``, whose result has been written."""

    def wrap(function: Stage) -> Stage:
        @functools.wraps(function)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if before:
                scratch.release(spark, _owner(sf_dir, before))
            with scratch.owner(_owner(sf_dir, function.__name__)):
                return function(spark, docs, sf_dir)

        return run

    return wrap


@stage(None)
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or with a narrow margin between languages. Nothing else of a document changes."""
    judged = identify(docs, learn(docs), docs.columns)
    return judged.where(~F.col("rejected")).select(docs.columns)


@stage("language")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group that shares at least 0.8 of its five-word shingles; null doc_ids stay."""
    gone = near_duplicates(docs, size=5, part=80, whole=100).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


@stage("near_dedup")
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes strings of PASSAGE bytes that occur twice or more out of all texts; documents of which nothing is left go."""
    cut = without_repeats(docs, PASSAGE).where("text is not null and text <> ''")
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


@stage("suffix_dedup")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten successive words, or a whole shorter item, of the benchmark; null doc_ids stay."""
    hit = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.size("items") > 0).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(docs.columns)


@stage("decontaminate")
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: Compression sizes and tokens can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again; the last result's tables stay until the session ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, apply), (reader, _) in zip(STAGES, STAGES[1:], strict=False):
        out = apply(spark, docs, sf_dir)
        # It goes when the stage that reads it has written its own.
        with scratch.owner(_owner(sf_dir, reader)):
            path = scratch.new_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
