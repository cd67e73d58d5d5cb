"""Queries over texts, streams and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.functions import text
from engramark.operators import automaton, mentions
from engramark.sources.workloads import table
from engramark.streaming import replay, tombstones

ALIASES = {"and": "AND", "the": "THE", "der": "DER"}
ENTITIES = {"the": ("the", "that"), "of": ("of", "for"), "und": ("und", "der")}


def mention_map(spark: SparkSession, d: str) -> DataFrame:
    x = mentions.substituted(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", ALIASES)
    return x.select("conv_id", "turn", F.sha2("normalized", 256).alias("sha256"))


def alias_texts(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the turns with every word of the benchmark of four letters or more put in brackets wherever it stands, by one automaton."""
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("alias"))
    x = automaton.substituted(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", {a: f"[{a}]" for a in automaton.known(words)})
    return x.select("conv_id", "turn", F.sha2("normalized", 256).alias("sha256"))


def one_entity(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "conversations").withColumn("entity", mentions.single_entity(F.col("text"), ENTITIES))
    return x.groupBy("entity").agg(F.count("*").alias("n"))


def name_spans(spark: SparkSession, d: str) -> DataFrame:
    """Names in each turn, and the turn with all of them spliced out."""
    x = mentions.named(table(spark, d, "conversations").select("conv_id", "turn", "text"), "text", ("License",))
    return x.select("conv_id", "turn", F.size("spans").alias("n_spans"), mentions.spliced("text", "spans", F.lit("[name]")).alias("masked"))


def message_roles(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation as a list, in order, with only the contents changed."""
    x = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.concat(F.lit("> "), F.col("text")).alias("content")))).alias("m"))
    return x.select("conv_id", F.size("m").alias("turns"), F.sha2(F.array_join(F.transform("m", lambda r: F.concat(r["role"], F.lit("="), F.coalesce(r["content"], F.lit("")))), "\n"), 256).alias("sha256"))


def answer_lists(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", F.concat(F.lit("1. "), F.col("event_type"), F.lit("\n- "), F.col("props"), F.lit(", "), F.col("event_type")).alias("answer"))
    return x.select("event_id", F.array_join(text.list_items("answer"), "|").alias("items"))


def json_attributes(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return x.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def score_functions(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").select("event_id", F.col("value").alias("v"), (F.col("event_id") % 30).alias("days"), (F.col("event_id") % 5 + 1).alias("n"))
    return x.select("event_id", F.round(text.utility(F.col("days"), F.col("n"), 0.1), 8).alias("utility"), F.round(text.discount(F.col("n").cast("double")), 8).alias("gamma"), (0.5 * F.pow(F.lit(2.0), F.col("n"))).alias("backoff"), F.round(text.uniform("x", F.col("event_id")), 8).alias("u"))


def stream_state(spark: SparkSession, d: str) -> DataFrame:
    return replay.finished(replay.node_activity(replay.event_stream(spark, f"{d}/events.parquet")))


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    x = replay.finished(replay.daily(replay.event_stream(spark, f"{d}/events.parquet")))
    return x.select(F.floor(F.unix_seconds(F.col("window.start")) / 86400).alias("day"), "event_type", "n")


#: Seconds for which a purchase counts as a tombstone of its user.
TTL = 6 * 3600


def _touched(spark: SparkSession, d: str) -> DataFrame:
    """The stream of events: a purchase collects its user, a view asks for it."""
    x = replay.event_stream(spark, f"{d}/events.parquet").where("event_type in ('purchase', 'view')")
    return x.select(F.col("user_id").cast("string").alias("node_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", "collect").otherwise("query").alias("op"), F.col("props").alias("superseded_by"), "event_id")


def stream_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Hits and evictions of tombstones that live for TTL, by a stateful stream with timers, up to its watermark."""
    return tombstones.appended(tombstones.lifetimes(_touched(spark, d), TTL)).select("node_id", "kind", "collected_ms", "at_ms")


def stream_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every view with the purchases of its user in the TTL before it, by a join of two streams."""
    asked = _touched(spark, d).where("op = 'query'").select("node_id", F.col("at").alias("asked_at"), F.col("event_id").alias("view"))
    kept = _touched(spark, d).where("op = 'collect'").select("node_id", F.col("at").alias("collected_at"), F.col("event_id").alias("purchase"))
    return tombstones.appended(tombstones.interval_hits(asked, kept, TTL)).select("view", "purchase")


QUERIES = {f.__name__: f for f in (mention_map, alias_texts, one_entity, name_spans, message_roles, answer_lists, json_attributes, score_functions, stream_state, stream_daily, stream_tombstones, stream_hits)}

_HIT = " + ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(chr(92) + 'b' + a + chr(92) + 'b' for a in xs)}') THEN 1 ELSE 0 END" for xs in ENTITIES.values())
_WHICH = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(chr(92) + 'b' + a + chr(92) + 'b' for a in xs)}') THEN '{c}'" for c, xs in ENTITIES.items())
_TOUCHED = "tc AS (SELECT CAST(user_id AS VARCHAR) AS node_id, epoch_ms(ts) AS at_ms, ts, CASE event_type WHEN 'purchase' THEN 'collect' ELSE 'query' END AS op, event_id FROM events WHERE event_type IN ('purchase', 'view'))"
SQL = {
    "stream_tombstones": f"""WITH {_TOUCHED}, w AS (SELECT max(at_ms) - 3600000 AS until FROM tc),
y AS (SELECT *, last_value(CASE WHEN op = 'collect' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY at_ms, op ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
  first_value(CASE WHEN op = 'collect' THEN at_ms END IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY at_ms, op ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM tc)
SELECT node_id, 'hit' AS kind, c AS collected_ms, at_ms FROM y WHERE op = 'query' AND at_ms - c <= {TTL * 1000}
UNION ALL SELECT node_id, 'evicted', at_ms, at_ms + {TTL * 1000} FROM y, w WHERE op = 'collect' AND (nx - at_ms > {TTL * 1000} OR (nx IS NULL AND at_ms + {TTL * 1000} < until))""",
    "stream_hits": f"WITH {_TOUCHED} SELECT q.event_id AS view, t.event_id AS purchase FROM tc q JOIN tc t ON q.node_id = t.node_id AND q.op = 'query' AND t.op = 'collect' AND q.ts >= t.ts AND q.ts <= t.ts + INTERVAL {TTL} SECOND",
    "alias_texts": r"""WITH w AS (SELECT string_agg(a, '|' ORDER BY length(a) DESC, a) AS p FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS a FROM benchmark))
SELECT conv_id, turn, sha256(regexp_replace(text, '(' || p || ')', '[\1]', 'g')) AS sha256 FROM conversations, w""",
    "mention_map": "SELECT conv_id, turn, sha256(replace(replace(replace(text, 'and', 'AND'), 'the', 'THE'), 'der', 'DER')) AS sha256 FROM conversations",
    "one_entity": f"SELECT entity, count(*) AS n FROM (SELECT CASE WHEN {_HIT} = 1 THEN CASE {_WHICH} END END AS entity FROM conversations) GROUP BY entity",
    "message_roles": "SELECT conv_id, CAST(count(*) AS INT) AS turns, sha256(string_agg(role || '=' || coalesce('> ' || text, ''), chr(10) ORDER BY turn, role, text)) AS sha256 FROM conversations GROUP BY conv_id",
    "answer_lists": r"""
SELECT event_id, array_to_string(list_transform(list_sort(list_distinct(list_transform(l, lambda x: {'p': list_position(l, x), 'x': x}))), lambda z: z.x), '|') AS items
FROM (SELECT event_id, list_filter(list_transform(string_split_regex('1. ' || event_type || chr(10) || '- ' || props || ', ' || event_type, '[\n,]'), lambda s: trim(regexp_replace(s, '^\s*(\d+[.)]|[-*])\s*', ''))), lambda s: s <> '') AS l FROM events)""",
    "json_attributes": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "score_functions": """
SELECT event_id, round(exp(-0.1 * (event_id % 30)) * (1 + ln(1 + event_id % 5 + 1)), 8) AS utility, round(0.4412 / ((event_id % 5 + 1) * log2(event_id % 5 + 2) ^ 2), 8) AS gamma, 0.5 * 2.0 ^ (event_id % 5 + 1) AS backoff,
  round(CAST(('0x' || substr(sha256('x:' || event_id), 1, 8)) AS UBIGINT) / 4294967296.0, 8) AS u FROM events""",
    "stream_state": "SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS queries, count(*) FILTER (event_type = 'purchase') AS adds, count(*) FILTER (event_type = 'error') AS removals, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY user_id",
    "stream_daily": "SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
}
