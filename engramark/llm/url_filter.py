"""URL filter: rules, and for the rest a ratio of two character language models.

The URLs that a rule allows and those that it blocks are the two training sets, of
which each gives a smoothed variable-order Markov model of a bounded sample: a
character's probability is interpolated from the longest context of up to ORDER
characters that was seen down to none. A URL is
allowed if the difference of its length-normalised log-likelihoods is above a
threshold calibrated on labelled URLs that trained neither model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = 5
#: Bounds of the fit: different URLs for each verdict, and characters of one. Every string of up to ORDER + 1 of their characters is kept.
FIT_URLS = 10_000
FIT_LENGTH = 2000
#: One labelled URL in so many calibrates; the others train.
CALIBRATE = 5
#: Characters that unseen ones share the last of the probability with.
ALPHABET = 4096
#: Width of the score bins in which the calibration is counted, and their number on either side.
BIN, BINS = 0.01, 1000
#: (verdict, host and path) of the task's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path: the host is lower-cased (A-Z); both are empty if url is null or has no ``://``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", "url", host.alias("host"), path.alias("path"))


def by_rule(rules: tuple = RULES) -> tuple[F.Column, F.Column]:
    """(rule, verdict) columns of the longest rule that fits host and path; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def spelled() -> F.Column:
    """What the models read of a URL: all after the scheme, digits as 0, between marks of its start and end."""
    rest = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://", "")
    return F.concat(F.lit("\x02"), F.regexp_replace(F.lower(rest), "[0-9]", "0"), F.lit("\x03"))


def gram_counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """verdict, gram, n: how often each string of up to order + 1 characters stands in the URLs (verdict, s, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v for v, _ in counts], pa.string()), pa.array([g for _, g in counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["verdict", "gram", "n"])

        for batch in batches:
            for verdict, s, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i in range(1, len(s)):
                    for k in range(min(order, i) + 1):
                        counts[verdict, s[i - k : i + 1]] += n
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()

    return urls.select("verdict", "s", "n").mapInArrow(run, "verdict string, gram string, n long").groupBy("verdict", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Probabilities of characters after contexts, by Witten-Bell interpolation over the contexts that were seen."""

    def __init__(self, grams: dict[str, int], order: int = ORDER) -> None:
        self.order, self.grams, self.memo = order, grams, {}
        self.total: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        for gram, n in grams.items():
            self.total[gram[:-1]] = self.total.get(gram[:-1], 0) + n
            self.kinds[gram[:-1]] = self.kinds.get(gram[:-1], 0) + 1

    def probability(self, gram: str) -> float:
        found = self.memo.get(gram)
        if found is None:
            context = gram[:-1]
            found = self.probability(gram[1:]) if context else 1 / ALPHABET
            if total := self.total.get(context):
                kinds = self.kinds[context]
                found = (self.grams.get(gram, 0) + kinds * found) / (total + kinds)
            if len(self.memo) < 1 << 20:
                self.memo[gram] = found
        return found

    def mean_log(self, s: str) -> float:
        return sum(math.log(self.probability(s[max(0, i - self.order) : i + 1])) for i in range(1, len(s))) / (len(s) - 1)


def fit(labelled: DataFrame) -> dict[str, dict[str, int]]:
    """The strings of the models allow and block and their counts, from (verdict, s): of each the FIT_URLS with the smallest hashes, each once."""
    models: dict[str, dict[str, int]] = {}
    for verdict in ("allow", "block"):
        short = labelled.where((F.col("verdict") == verdict) & (F.char_length("s") <= FIT_LENGTH)).select("s").distinct()
        sample = short.orderBy(F.xxhash64("s"), "s").limit(FIT_URLS)
        counts = gram_counts(sample.select(F.lit(verdict).alias("verdict"), "s", F.lit(1).alias("n")))
        models[verdict] = {r["gram"]: r["n"] for r in counts.toLocalIterator()}
    return models


def scored(urls: DataFrame, models: dict[str, dict[str, int]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ratio, the difference of mean log-likelihoods of s."""
    given = urls.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow, block = Model(given.value["allow"]), Model(given.value["block"])
        memo: dict[str, float] = {}
        for batch in batches:
            ratios = []
            for s in batch.column(batch.num_columns - 1).to_pylist():
                if s not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[s] = allow.mean_log(s) - block.mean_log(s)
                ratios.append(memo[s])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ratios, pa.float64())], [*keep, "ratio"])

    return urls.select(*keep, "s").mapInArrow(run, urls.select(*keep).schema.add("ratio", "double"))


def calibrated(labelled: DataFrame, models: dict[str, dict[str, int]]) -> float:
    """The threshold with the best mean of both sets' accuracies; the middle one of equally good ones. 0 if a set is empty."""
    bin_ = F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("ratio") / BIN))).alias("bin")
    rows = scored(labelled, models, ["verdict", "n"]).groupBy("verdict", bin_).agg(F.sum("n").alias("n")).collect()
    total = Counter()
    for r in rows:
        total[r["verdict"]] += r["n"]
    if len(total) < 2:
        return 0.0
    gain: Counter = Counter()
    for r in rows:
        gain[r["bin"]] += r["n"] / total[r["verdict"]] * (1 if r["verdict"] == "block" else -1)
    best, right, now = [], -1.0, 0.0
    for edge in range(-BINS, BINS + 1):
        now += gain.get(edge, 0)
        if now > right + 1e-12:
            best, right = [], now
        if now > right - 1e-12:
            best.append(edge + 1)
    return best[len(best) // 2] * BIN


def judged(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and ratio (the method's score, null where a rule decides) for every row.

    A null or malformed url has an empty host and path, no rule, and the method's
    verdict on what there is of it. With no allowed or no blocked URL to learn from
    that model is uniform. Repeated rows give repeated results, an empty table none.
    """
    rule, verdict = by_rule(rules)
    ruled = with_host_and_path(pages).withColumn("rule", rule).withColumn("verdict", verdict).withColumn("s", spelled())
    known = ruled.where("verdict is not null").groupBy("verdict", "s").agg(F.count("*").alias("n"))
    fold = F.pmod(F.xxhash64("s"), F.lit(CALIBRATE))
    models = fit(known.where(fold != 0))
    threshold = calibrated(known.where(fold == 0), models)
    open_ = scored(ruled.where("verdict is null"), models, ["page_id", "host", "path", "rule"])
    open_ = open_.withColumn("verdict", F.when(F.col("ratio") >= threshold, "allow").otherwise("block"))
    decided = ruled.where("verdict is not null").select("page_id", "host", "path", "rule", F.lit(None).cast("double").alias("ratio"), "verdict")
    return decided.unionByName(open_).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op4_url_filter": op4_url_filter}
SQL: dict[str, str] = {}
