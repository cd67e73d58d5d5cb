"""Tombstones in streams: state that lives for a time and expires by event time, and interval joins of two streams.

Events are (node_id, at, op, superseded_by): a collect leaves a tombstone of its
node, in the place of an older one; a query hits the tombstone that is there. The state
is one tombstone a node, whose timer removes it when the watermark has passed its time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from engramark.streaming.replay import _folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "collected_ms long, superseded_by string"
OUTPUT = "node_id string, kind string, collected_ms long, at_ms long, superseded_by string"
COLUMNS = ("node_id", "kind", "collected_ms", "at_ms", "superseded_by")


def _millis(at: Column) -> Column:
    """Milliseconds of a time, rounded half away from 0 as DuckDB's epoch_ms does; Spark's own cut off."""
    return F.round(F.unix_micros(at) / 1000).cast("long")


class Tombstones(StatefulProcessor):
    """A node's tombstone: rows of a key are handled in the order of (at_ms, op), so that a collect and a query of one moment make a hit."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.tomb = handle.getValueState("tomb", STATE)

    def _now(self) -> tuple[int, str | None] | None:
        return (lambda t: (int(t[0]), t[1]))(self.tomb.get()) if self.tomb.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        x = pd.concat(list(rows)).sort_values(["at_ms", "op"], kind="stable")
        tomb, out = self._now(), []
        before = tomb
        for at, op, by in x[["at_ms", "op", "superseded_by"]].itertuples(index=False):
            over = tomb and at - tomb[0] > self.ttl
            if op == "collect":
                if over:
                    out.append((key[0], "evicted", tomb[0], tomb[0] + self.ttl, tomb[1]))
                tomb = (int(at), None if pd.isna(by) else by)
            elif tomb and not over:
                out.append((key[0], "hit", tomb[0], int(at), tomb[1]))
        if tomb != before:
            if before:
                self.handle.deleteTimer(before[0] + self.ttl + 1)
            self.tomb.update(tomb)
            # A timer goes off at its own time; a tombstone is over a moment later.
            self.handle.registerTimer(tomb[0] + self.ttl + 1)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        tomb = self._now()
        if tomb:
            self.tomb.clear()
            yield pd.DataFrame([(key[0], "evicted", tomb[0], tomb[0] + self.ttl, tomb[1])], columns=COLUMNS)

    def close(self) -> None:
        pass


def lifetimes(events: DataFrame, ttl: float, late: str = "1 hour") -> DataFrame:
    """The stream of hits and evictions (OUTPUT) of a stream of events; ttl is in seconds.

    An eviction's time is the end of the tombstone's life, whichever batch finds it; it comes when a later collect
    takes the place or the watermark has passed that time, not with a query before. Events later
    than the watermark, ``late`` behind the latest, are lost, as is usual for streams;
    null nodes and times are left out. Equal whatever the batches are, as long as nothing is late.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # The watermark goes by the same rounded times as the timers.
    x = events.where("node_id is not null and at is not null").withColumn("at_ms", _millis(F.col("at"))).withColumn("at", F.timestamp_millis("at_ms")).withWatermark("at", late)
    x = x.select(F.col("node_id").cast("string").alias("node_id"), "at", "at_ms", "op", F.col("superseded_by").cast("string").alias("superseded_by"))
    return x.groupBy("node_id").transformWithStateInPandas(Tombstones(round(ttl * 1000)), OUTPUT, "append", "eventTime")


def lifetimes_of_log(events: DataFrame, ttl: float, until_ms: int) -> DataFrame:
    """The same of a table of events, as far as a watermark ``until_ms`` tells: by windows over each node's events."""
    ms = round(ttl * 1000)
    x = events.where("node_id is not null and at is not null").select(F.col("node_id").cast("string").alias("node_id"), _millis(F.col("at")).alias("at_ms"), "op", F.col("superseded_by").cast("string").alias("superseded_by"))
    order = Window.partitionBy("node_id").orderBy("at_ms", "op")
    tomb = F.last(F.when(F.col("op") == "collect", F.struct(F.col("at_ms").alias("c"), F.col("superseded_by").alias("by"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # The next collect, from the last event to the first: a frame that ends with the partition is gone through anew for each row.
    back = Window.partitionBy("node_id").orderBy(F.desc("at_ms"), F.desc("op")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(F.col("op") == "collect", F.col("at_ms")), ignorenulls=True).over(back)
    y = x.withColumn("tomb", tomb).withColumn("next", following)
    hits = y.where((F.col("op") == "query") & (F.col("at_ms") - F.col("tomb.c") <= ms)).select("node_id", F.lit("hit").alias("kind"), F.col("tomb.c").alias("collected_ms"), "at_ms", F.col("tomb.by").alias("superseded_by"))
    over = (F.col("next") - F.col("at_ms") > ms) | (F.col("next").isNull() & (F.col("at_ms") + ms < until_ms))
    gone = y.where((F.col("op") == "collect") & over).select("node_id", F.lit("evicted").alias("kind"), F.col("at_ms").alias("collected_ms"), (F.col("at_ms") + ms).alias("at_ms"), "superseded_by")
    return hits.union(gone)


def alive(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(node_id, collected_ms, superseded_by): the tombstones in the state of a stream's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "tomb").load()
    return state.select(F.col("key.node_id").alias("node_id"), "value.collected_ms", "value.superseded_by")


def appended(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns all that it has put out, a table in the shared folder.

    With the ``folder`` of an earlier run it goes on from where that stopped: state and output are taken up.
    """
    spark = stream.sparkSession
    folder = folder or _folder(spark)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def interval_hits(queries: DataFrame, tombstones: DataFrame, ttl: float, late: str = "1 hour") -> DataFrame:
    """queries (node_id, asked_at, ...) joined with the tombstones (node_id, collected_at, ...) that are not older than ttl seconds and not younger than the query.

    Of two streams either side is kept only while the other's watermark, ``late`` behind
    its latest row, may still bring a partner; of two tables it is the same join.
    """
    q, t = queries.alias("q"), tombstones.alias("t")
    if queries.isStreaming:
        q, t = queries.withWatermark("asked_at", late).alias("q"), tombstones.withWatermark("collected_at", late).alias("t")
    on = (F.col("q.node_id") == F.col("t.node_id")) & (F.col("q.asked_at") >= F.col("t.collected_at")) & (F.col("q.asked_at") <= F.col("t.collected_at") + F.expr(f"interval {ttl} seconds"))
    return q.join(t, on).select("q.*", *(f"t.{c}" for c in tombstones.columns if c != "node_id"))


def next_ticks(events: DataFrame, ticks: DataFrame, every: int, late: str = "1 hour") -> DataFrame:
    """events (at, ...) with tick, the first of the ticks (tick) not before it, where one comes within ``every`` seconds: an as-of join of two streams.

    A tick is a time that ``every`` divides; it is found by the number of its period, the range bounds what is kept.
    """
    period = lambda c: F.ceil(F.unix_millis(c) / (1000 * every))
    e, t = events.withColumn("_p", period("at")), ticks.select("tick", period("tick").alias("_q"))
    if events.isStreaming:
        e, t = e.withWatermark("at", late), t.withWatermark("tick", late)
    on = (F.col("_p") == F.col("_q")) & (F.col("tick") >= F.col("at")) & (F.col("tick") <= F.col("at") + F.expr(f"interval {every} seconds"))
    return e.join(t, on).drop("_p", "_q")
