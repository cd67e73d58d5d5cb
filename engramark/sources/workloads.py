"""The engine's inputs, read from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, source_id, input, oracle: each part's name in one of four spellings, by brand."""
    part = table(spark, sf_dir, "part")
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    camel = F.concat(F.lower(first), F.upper(F.left(second, F.lit(1))), F.lower(F.substring(second, 2, 1000)))
    kind = F.col("p_partkey") % 4
    spelled = F.when(kind == 0, F.col("p_name")).when(kind == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).when(kind == 2, camel).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    return part.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("source_id"), spelled.alias("input"), F.col("p_name").alias("oracle"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact, entity, at: an order's fact mentions a part; at is in seconds."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(F.col("l_orderkey").alias("fact"), F.col("l_partkey").alias("entity"), F.unix_timestamp("l_shipdate").cast("double").alias("at"), "l_returnflag", "l_linestatus", "l_linenumber")


SURFACE_SQL = """surface AS (
  SELECT p_partkey AS seq, p_brand AS source_id, p_name AS oracle, CASE p_partkey % 4
    WHEN 0 THEN p_name
    WHEN 1 THEN upper(replace(p_name, ' ', '_'))
    WHEN 2 THEN lower(split_part(p_name, ' ', 1)) || upper(left(split_part(p_name, ' ', 2), 1)) || lower(substr(split_part(p_name, ' ', 2), 2))
    ELSE replace(p_name, ' ', '-') END AS input
  FROM part)"""
TOKENS_SQL = r"list_filter(string_split_regex(lower(translate(regexp_replace(regexp_replace(input, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_-', '  ')), '\s+'), lambda t: t <> '')"
STUB_SQL = "'BUCKET_' || lpad(CAST(list_reduce(list_prepend(0, list_transform(string_split(sha256(input), ''), lambda d: CAST(('0x' || d) AS INT))), lambda a, d: (a * 16 + d) % 34) AS VARCHAR), 2, '0')"
