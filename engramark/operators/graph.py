"""Connected components of an undirected graph."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on one machine; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="engramark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that the cluster shares."""
    spark: SparkSession = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: for long tables far fewer bytes than a checkpoint's rows."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of edges (u, v), by least labels with pointer jumping."""
    both = reliable(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = reliable(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("component").alias("m"))
        hop = labels.join(near, labels["node"] == near["u"]).select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = hop.select(F.col("node").alias("j"), F.col("component").alias("far"))
        after = reliable(hop.join(jump, hop["component"] == jump["j"]).select("node", F.least("component", "far").alias("component"), "old"))
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels


def extended(components: DataFrame, edges: DataFrame) -> DataFrame:
    """components (node, component) after more edges (u, v): what connected() gives for all edges together.

    Only the classes that the new edges touch become a graph, a node for each; its classes
    say what the touched ones are now. The stored table is read by joins with the delta, never gone through in rounds.
    """
    edges = reliable(edges.select("u", "v").where("u is not null and v is not null"))
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    now = reliable(ends.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # A loop alone makes no class.
    fresh = now.join(components.select("node"), "node", "left_anti").join(edges.where("u <> v").select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi")
    of = lambda end, name: now.select(F.col("node").alias(end), F.col("component").alias(name))
    met = edges.join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    moved = connected(met).select(F.col("node").alias("component"), F.col("component").alias("into"))
    every = components.select("node", "component").union(fresh.select("node", "component"))
    return every.join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
