"""Event logs as streams: node state and daily windows, kept by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.operators.graph import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of Parquet files as a stream; ``path`` is a file, or a folder of files."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def finished(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its result as of the last batch, a table in the shared folder."""
    spark = stream.sparkSession
    folder = _folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def node_activity(events: DataFrame) -> DataFrame:
    """Per user: first and last event, queries (view, click), writes (purchase) and removals (error)."""
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count_if(kind.isin("view", "click")).alias("queries"), F.count_if(kind == "purchase").alias("adds"), F.count_if(kind == "error").alias("removals"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.max("ts").cast("timestamp")).alias("last_us"))


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events of each type in each day, with a watermark for late ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
