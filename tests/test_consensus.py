"""Clustering and consensus against plain Python, write by write and pair by pair."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from engramark.operators import canonical, consensus
from engramark.functions import text

WORDS = ["red", "blue", "big", "small", "ring", "bolt", "gear", "plate", "anvil", "of", "by", "3", "7"]


def forms(seed, n=150, sources=4):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        name = " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 5)))
        rows.append((k, f"s{r.randrange(sources)}", r.choice((name, name.replace(" ", "_"), name.title().replace(" ", ""))), [r.gauss(0, 1) if r.random() < 0.9 else 0.0 for _ in range(6)] if r.random() < 0.95 else [0.0] * 6))
    return rows


def tokens(x):
    for p in ("([A-Z]+)([A-Z][a-z])", "([a-z0-9])([A-Z])"):
        x = re.sub(p, r"\1 \2", x)
    return x.replace("_", " ").replace("-", " ").lower().split()


def embed(x):
    vec = {}
    for t in tokens(x):
        h = int(hashlib.sha256(t.encode()).hexdigest(), 16)
        vec[h % 4096] = vec.get(h % 4096, 0.0) + (1.0 if h >> 8 & 1 else -1.0)
    n = math.sqrt(sum(v * v for v in vec.values()))
    return {k: v / n for k, v in vec.items()} if n else {}


def joined(x, vector, weights):
    n = math.sqrt(sum(v * v for v in vector))
    parts = {("t", k): weights[0] * v for k, v in embed(x).items()} | {("v", k): weights[1] * v / n for k, v in enumerate(vector) if n}
    n = math.sqrt(sum(v * v for v in parts.values()))
    return {k: v / n for k, v in parts.items()} if n else {}


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def may_merge(a, b):
    if re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return False
    split = lambda x: re.sub(r"\s+", " ", x.replace("_", " ").replace("-", " ").lower()).strip().split(" ")
    x, y = sorted((split(a), split(b)), key=len)
    return not (len(y) == len(x) + 1 and y[:-1] == x and y[-1] in text.TRAILING_WORDS)


@pytest.mark.parametrize(("threshold", "guarded", "weights"), [(0.7, True, (1.0, 0.0)), (0.75, False, (0.0, 1.0)), (0.8, False, (2.0, 1.0)), (0.8, True, (2.0, 1.0))])
def test_leader_clusters(spark, threshold, guarded, weights):
    rows = forms(5)
    seen, want = {}, {}
    first = {}
    for k, s, x, v in rows:
        first.setdefault((s, x), v)
    for k, s, x, _ in rows:
        if (s, x) in want:
            continue
        mine = joined(x, first[s, x], weights)
        scored = [(dot(mine, e), -j) for j, (_, e) in enumerate(seen.setdefault(s, []))]
        top = max(scored, default=None)
        if top and top[0] >= threshold - 1e-9 and (not guarded or may_merge(x, seen[s][-max(j for c, j in scored if c > top[0] - 1e-9)][0])):
            want[s, x] = seen[s][-max(j for c, j in scored if c > top[0] - 1e-9)][0]
        else:
            seen[s].append((x, mine))
            want[s, x] = x
    df = spark.createDataFrame(rows, "seq long, source_id string, input string, vector array<double>")
    got = {(x["source_id"], x["input"]): x["label"] for x in canonical.leader_clusters(df, threshold, guarded, weights).collect()}
    assert got == want and len(set(want.values())) < len(want)


def test_hashed_index_finds_most(spark):
    rows = forms(6, 300)
    df = spark.createDataFrame(rows, "seq long, source_id string, input string, vector array<double>")
    labels = [{(x["source_id"], x["input"]): x["label"] for x in canonical.leader_clusters(df, 0.8, True, (2.0, 1.0), index).collect()} for index in ("linear", "hashed")]
    assert sum(labels[0][k] == labels[1][k] for k in labels[0]) >= 0.9 * len(labels[0])


def writes(seed, n=160, sources=3):
    r = random.Random(seed)
    out = []
    for k in range(n):
        label = r.choice("ABCDEF")
        alias = f"{label.lower()}{r.randrange(4)}" if r.random() < 0.8 else f"x{r.randrange(5)}"
        vector = [1.0 if label == c else 0.0 for c in "ABCDEF"]
        vector[r.randrange(6)] += r.random()
        out.append((k, f"s{r.randrange(sources)}", alias, label, vector))
    return out


def brute(rows, rule, jaccard, cosine, min_aliases, min_overlap):
    order, aliases, sums = [], {}, {}
    for _, s, a, label, v in rows:
        k = (s, label)
        if k not in aliases:
            order.append(k)
        aliases.setdefault(k, set()).add(a)
        sums[k] = [x + y for x, y in zip(sums.get(k, [0.0] * 6), v, strict=True)]
    unit = {k: [x / math.sqrt(sum(y * y for y in v)) for x in v] for k, v in sums.items()}
    parent = {k: k for k in order}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    reasons = {}
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if a[0] == b[0] or len(aliases[a]) < min_aliases or len(aliases[b]) < min_aliases:
                continue
            common = len(aliases[a] & aliases[b])
            if rule == "all" and common < min_overlap:
                continue
            j = common / len(aliases[a] | aliases[b]) >= jaccard
            c = sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= cosine
            if rule == "all":
                reason = "and_passed" if j and c else "blocked_cosine_below" if j else "blocked_jaccard_below" if c else "blocked_both"
            else:
                reason = "both" if j and c else "jaccard_only" if j else "cosine_only" if c else None
            if reason:
                reasons[reason] = reasons.get(reason, 0) + 1
            if reason in ("and_passed", "both", "jaccard_only", "cosine_only"):
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[rb] = ra
    size = {}
    for k in order:
        size[find(k)] = size.get(find(k), 0) + 1
    return {k: f"merged::{find(k)[1]}" if size[find(k)] > 1 else f"{k[0]}::{k[1]}" for k in order}, reasons


WRITES = "seq long, source_id string, input string, label string, vector array<double>"


@pytest.mark.parametrize(("rule", "least", "seed"), [("any", 2, 1), ("all", 2, 1), ("all", 1, 2), ("any", 2, 3)])
def test_consensus_rules(spark, rule, least, seed):
    rows = writes(seed)
    want, reasons = brute(rows, rule, 0.4, 0.9, least, 2)
    df = spark.createDataFrame(rows, WRITES)
    pairs = consensus.judged_pairs(df, rule, 0.4, 0.9, least, 2)
    assert {x["reason"]: x["n"] for x in pairs.groupBy("reason").count().withColumnRenamed("count", "n").collect()} == reasons
    assert {(x["source_id"], x["label"]): x["merged"] for x in consensus.merged(df, pairs).collect()} == want
    assert any(x.startswith("merged") for x in want.values())


def test_adaptive_settings(spark):
    alike = [(k, f"s{k % 2}", f"a{k // 2 % 3}", "ABCDEF"[k // 6 % 2], [1.0 if k // 6 % 2 == c else 0.0 for c in range(6)]) for k in range(24)]
    _, chosen = consensus.adaptive(spark.createDataFrame(alike, WRITES))
    assert chosen["min_aliases"] == 1 and chosen["kind"] == "global_stratum_heavy"
    apart = [(k, f"s{k % 3}", f"a{k}", "ABC"[k // 3 % 3], [float(c == k % 6) for c in range(6)]) for k in range(36)]
    every, chosen = consensus.adaptive(spark.createDataFrame(apart, WRITES))
    assert chosen == {"density": 0.0, "min_aliases": 2, "kind": "ambiguity_heavy"} and every.where("merged <> k").isEmpty()


def test_identity_merges(spark):
    rows = [("s1", "Apple", "Apple"), ("s2", "Apple", "Apple"), ("s1", "Pear", "Pear"), ("s2", "Fig", "Fig"), ("s3", "fig tree", "fig tree"), ("s3", "Fig", "Fig"), ("s1", "Kiwi", "kiwi"), ("s2", "ab", "ab"), ("s2", "xabx", "xabx")]
    df = spark.createDataFrame([(k, s, a, label, [1.0]) for k, (s, label, a) in enumerate(rows)], WRITES)
    every = consensus.merged(df, consensus.judged_pairs(df, "all"))
    got = {(x["source_id"], x["label"]): x["merged"] for x in consensus.identity_merges(every, df).collect()}
    assert got == {("s1", "Apple"): "merged-identity::Apple", ("s2", "Apple"): "merged-identity::Apple", ("s1", "Pear"): "Pear", ("s2", "Fig"): "s2::Fig", ("s3", "Fig"): "s3::Fig", ("s3", "fig tree"): "s3::fig tree", ("s1", "Kiwi"): "s1::Kiwi", ("s2", "ab"): "s2::ab", ("s2", "xabx"): "s2::xabx"}


def test_eager_consensus(spark):
    rows = writes(7)
    aliases, named, want = {}, {}, []
    for _, s, a, label, _ in rows:
        key = (s, label)
        aliases.setdefault(key, set()).add(a)
        name = named.get(key)
        if name is None and len(aliases[key]) >= 2:
            best, near = None, 0.0
            for other, theirs in aliases.items():
                if other[0] != s and len(theirs) >= 2 and (score := len(aliases[key] & theirs) / len(aliases[key] | theirs)) > near:
                    best, near = other, score
            if best and near >= 0.5:
                name = named.get(best, f"merged::{best[1]}")
                named[key] = named[best] = name
        want.append(name or f"{s}::{label}")
    got = consensus.eager(spark.createDataFrame(rows, WRITES)).orderBy("seq").collect()
    assert [x["merged"] for x in got] == want and any(x.startswith("merged") for x in want)


def test_near_pairs(spark):
    r = random.Random(8)
    vectors = {f"k{n}": {i: r.random() for i in r.sample(range(12), 4)} for n in range(60)}
    rows = [(k, i, x / math.sqrt(sum(y * y for y in v.values()))) for k, v in vectors.items() for i, x in v.items()]
    unit = {}
    for k, i, x in rows:
        unit.setdefault(k, {})[i] = x
    want = {(a, b) for a in unit for b in unit if a < b and dot(unit[a], unit[b]) >= 0.8}
    got = consensus.near_pairs(spark.createDataFrame(rows, "k string, i int, c double"), 0.8)
    assert {(x["u"], x["v"]) for x in got.collect()} == want and want


def test_normalizer_and_cadence(spark):
    rows = [(k, s, x) for k, (s, x) in enumerate([("a", "red ring"), ("b", "red ring"), ("a", "RedRing"), ("b", "RedRing"), ("a", "blue bolt"), ("b", "red_ring"), ("a", "red_ring"), ("b", "red ring")])]
    df = spark.createDataFrame(rows, "seq long, source_id string, input string")
    names, normalizer = consensus.cadenced(spark, df, 4)
    got = [x["name"] for x in names.orderBy("seq").collect()]
    assert got[:4] == ["a::red ring", "b::red ring", "a::red ring", "b::red ring"] and got[4] == "a::blue bolt" and got[5:] == ["merged::red ring"] * 3
    assert normalizer.known_sources() == ["a", "b"] and not normalizer.schedule_required() and normalizer.last["merged"] == 2
    known = spark.createDataFrame([("rr", "red ring")], "alias string, canonical string")
    seeded = canonical.pre_seeded(spark.createDataFrame([(0, "a", "rr"), (1, "a", "RedRing"), (2, "a", "anvil")], "seq long, source_id string, input string"), known)
    assert {x["seq"]: x["label"] for x in seeded.collect()} == {0: "red ring", 1: "red ring", 2: "anvil"}


def test_normalizer_goes_by_what_is_new(spark):
    """After each batch: the labels of going through all writes, and the names of consolidating all of them, with only some classes made anew."""
    r = random.Random(13)
    nouns = ["ring", "bolt", "gear", "plate", "rod"]
    rows = [(k, f"s{r.randrange(3)}", r.choice((" ".join, "_".join))([r.choice(("red", "Red", "big")), r.choice(nouns[: 2 + k // 12])]) + r.choice(("", " x", " x y"))) for k in range(48)]
    normalizer = consensus.Normalizer(spark)
    renamed = []
    for start in range(0, 48, 16):
        normalizer.normalize(spark.createDataFrame(rows[start : start + 16], "seq long, source_id string, input string"))
        normalizer.consolidate()
        whole = spark.createDataFrame(rows[: start + 16], "seq long, source_id string, input string")
        labels = canonical.leader_clusters(whole, 0.7)
        key = lambda df, *c: sorted(tuple(x[k] for k in c) for x in df.collect())
        assert key(normalizer.writes, "seq", "label") == key(labels, "seq", "label")
        buckets = F.transform(text.tokens("input"), lambda t: text.token_bucket(t) % 256)
        vector = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
        labels = labels.withColumn("vector", vector)
        full = consensus.merged(labels, consensus.judged_pairs(labels, "all"))
        assert key(normalizer.names, "source_id", "label", "merged") == key(full, "source_id", "label", "merged")
        renamed.append((normalizer.renamed, full.count()))
    assert renamed[-1][0] < renamed[-1][1]
