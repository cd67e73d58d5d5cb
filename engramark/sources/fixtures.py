"""Workload files in JSON as (seq, source_id, input, oracle). A file is one document, so its rows are numbered within it without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROPERTIES = "properties array<struct<label: string, aliases: array<string>>>"
SURFACES = "surfaces array<struct<surface: string, candidates: array<struct<domain: string, actual_label: string, aliases: array<string>>>>>"
TAGS = "by_source array<struct<source: string, related_tags: array<string>, synonyms: array<array<string>>>>"
MEMORY_ITEMS = "question_id string, question string, answer string"
PAIRS = "pairs array<struct<a: string, b: string, cosine: double>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _entry(source: Column, form: Column, oracle: Column) -> Column:
    return F.struct(source.alias("source_id"), form.alias("input"), oracle.alias("oracle"))


def _all(values: Column) -> Column:
    """The array, empty where the file has none."""
    return F.coalesce(values, F.array().cast("array<string>"))


def _numbered(df: DataFrame, entries: Column) -> DataFrame:
    return df.select(F.posexplode(entries).alias("seq", "e")).select(F.col("seq").cast("long").alias("seq"), "e.*")


def properties(spark: SparkSession, path: str) -> DataFrame:
    """Each property's label, then its aliases, of one source."""
    one = lambda p: F.transform(F.concat(F.array(p["label"]), _all(p["aliases"])), lambda form: _entry(F.lit("default"), form, p["label"]))
    return _numbered(_json(spark, path, PROPERTIES), F.flatten(F.transform("properties", one)))


def ambiguous_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """For each meaning of a surface form, by domain: the form, the label where it differs in more than case, and the aliases."""

    def forms(surface: Column, c: Column) -> Column:
        label = F.when(F.lower(c["actual_label"]) != F.lower(surface), F.array(c["actual_label"])).otherwise(_all(F.lit(None)))
        return F.transform(F.concat(F.array(surface), label, _all(c["aliases"])), lambda form: _entry(c["domain"], form, c["actual_label"]))

    one = lambda s: F.flatten(F.transform(s["candidates"], lambda c: forms(s["surface"], c)))
    return _numbered(_json(spark, path, SURFACES), F.flatten(F.transform("surfaces", one)))


def surfaces_of_several(spark: SparkSession, path: str) -> DataFrame:
    """surface: the forms with more than one meaning."""
    return _json(spark, path, SURFACES).select(F.explode("surfaces").alias("s")).where(F.size("s.candidates") > 1).select("s.surface")


def tags(spark: SparkSession, path: str) -> DataFrame:
    """Each source's related tags, which name themselves, then its synonyms."""

    def one(s: Column) -> Column:
        own = F.transform(_all(s["related_tags"]), lambda t: _entry(s["source"], t, t))
        pairs = F.coalesce(s["synonyms"], F.array().cast("array<array<string>>"))
        return F.concat(own, F.transform(pairs, lambda p: _entry(s["source"], p[0], p[1])))

    return _numbered(_json(spark, path, TAGS), F.flatten(F.transform("by_source", one)))


def memory_items(spark: SparkSession, path: str) -> DataFrame:
    """source_id, input, oracle: the question and the answer of each item that has both; question_id orders them."""
    x = _json(spark, path, MEMORY_ITEMS).select("question_id", F.trim("question").alias("q"), F.trim("answer").alias("a")).where("q <> '' and a <> ''")
    return x.selectExpr("stack(2, 'haystack', q, question_id, 'answer', a, question_id) as (source_id, input, oracle)")


def adversarial_pairs(spark: SparkSession, path: str) -> DataFrame:
    """a, b, cosine of a file of pairs."""
    return _json(spark, path, PAIRS).select(F.explode("pairs").alias("p")).select("p.*")
