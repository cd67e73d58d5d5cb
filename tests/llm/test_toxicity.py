"""The field against enumeration of all taggings, its slope against differences, its marks against plain words; held-out accuracy of scores."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from engramark.llm import toxicity

SCHEMA = "doc_id long, text string, score double, spans string, _text int"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def field(seed, n):
    r = np.random.default_rng(seed)
    return toxicity.Field(np.sort(r.integers(1, 1 << 63, n, np.uint64)), np.zeros(n, bool), r.normal(size=(3, n)), float(r.normal()), r.normal(size=(2, 2)), r.normal(size=2), np.zeros(4))


def chain(seed, lengths, marks):
    r = np.random.default_rng(seed)
    pointer = np.r_[0, np.cumsum(lengths)]
    at = r.integers(-1, marks, (pointer[-1], 5)).astype(np.int32)
    return at, pointer, toxicity.firsts(len(at), pointer)


def weight(tags, e, f):
    return math.exp(f.start[tags[0]] + sum(f.step[a, b] for a, b in itertools.pairwise(tags)) + sum(x for x, t in zip(e, tags, strict=True) if t))


def test_marginals_and_loss():
    f = field(1, 6)
    at, pointer, first = chain(2, [1, 4, 0, 7, 2, 1], 6)
    e = toxicity.emissions(at, first, f)
    tags = np.random.default_rng(3).integers(0, 2, len(at))
    want, loss = [], 0.0
    for a, b in itertools.pairwise(pointer):
        own = [f.bias + sum(f.weights[k][m] for k, j in ((0, i - 1), (1, i), (2, i + 1)) if a <= j < b for m in at[j] if m >= 0) for i in range(a, b)]
        assert np.allclose(own, e[a:b])
        every = {t: weight(t, own, f) for t in itertools.product((0, 1), repeat=b - a)} if b > a else {}
        z = sum(every.values())
        want += [sum(w for t, w in every.items() if t[i]) / z for i in range(b - a)]
        loss += math.log(z / weight(tuple(tags[a:b]), own, f)) if b > a else 0
    assert np.allclose(toxicity.marginals(e, first, f), want)
    assert math.isclose(toxicity.loss_and_slope(at, first, tags, f)[0], loss)


def test_long_chains():
    """More tokens than a block, and steep emissions: the same as token by token."""
    f = field(4, 8)
    _, pointer, first = chain(5, [900, 3, 0, 1500, 1], 8)
    e = np.clip(np.random.default_rng(6).normal(size=len(first)) * 20, -toxicity.STEEP, toxicity.STEEP)
    p = toxicity.marginals(e, first, f)
    for a, b in itertools.pairwise(pointer):
        forward, backward = [], [np.zeros(2)]
        for i in range(a, b):
            v = f.start if i == a else np.logaddexp.reduce(forward[-1][:, None] + f.step, axis=0)
            forward.append(v + [0, e[i]])
        for i in range(b - 1, a, -1):
            backward.append(np.logaddexp.reduce(f.step + np.array([0, e[i]]) + backward[-1], axis=1))
        for i, (x, y) in enumerate(zip(forward, reversed(backward), strict=False)):
            s = x + y
            assert abs(p[a + i] - 1 / (1 + math.exp(min(700, s[0] - s[1])))) < 1e-9


def test_slope():
    f = field(7, 5)
    at, _, first = chain(8, [3, 300, 1], 5)
    tags = np.random.default_rng(9).integers(0, 2, len(at))
    v, found = toxicity._vector(f), toxicity.loss_and_slope(at, first, tags, f)
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-5
        ends = [toxicity.loss_and_slope(at, first, tags, toxicity._with_vector(f, v + s * step))[0] for s in (1, -1)]
        assert abs((ends[0] - ends[1]) / 2e-5 - found[1 + k]) < 1e-4


def test_minimised():
    a = np.diag([1.0, 10, 100])
    assert np.allclose(toxicity.minimised(lambda x: (x @ a @ x - 2 * x.sum(), 2 * a @ x - 2), np.ones(3), 60), [1, 0.1, 0.01], atol=1e-2)


@pytest.mark.parametrize("section", [7, 50, 1 << 20])
def test_words_and_marks(section, monkeypatch):
    monkeypatch.setattr(toxicity, "SECTION", section)
    r = random.Random(2)
    texts = ["", "...", "Été x", "a" * 100, *("".join(r.choice("abCé 1,") for _ in range(r.randrange(60))) for _ in range(50)), ""]
    raws = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raws), np.uint8), np.r_[0, np.cumsum([len(x) for x in raws])]
    want = [(i, m.start() + offs[i], m.end() + offs[i], m[0]) for i, raw in enumerate(raws) for m in WORD.finditer(bytes(c + 32 if 65 <= c <= 90 else c for c in raw))]
    got, hashes = [], {}
    for marks, first, last, text in toxicity.marked_words(data, offs):
        got += zip(text.tolist(), first.tolist(), last.tolist(), strict=True)
        for m, (_, _, _, word) in zip(marks, want[len(got) - len(marks) : len(got)], strict=True):
            for h, part in zip(m, [b"=" + word, *(b"^" + word[:k] if len(word) >= k else None for k in toxicity.BEGINNINGS)], strict=True):
                assert (h == 0) == (part is None) and hashes.setdefault(part, h) == h
    assert got == [w[:3] for w in want]
    known = [h for h in hashes.items() if h[0]]
    assert len({h for _, h in known}) == len(known)


def corpus(n=900, seed=5):
    """Clean texts, and toxic ones with a few of some words, or words with a certain beginning, in a random place."""
    r = random.Random(seed)
    syllables = ["ta", "ro", "mi", "né", "lo", "ka", "Su", "vi"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 5)))
    rows = []
    for k in range(n):
        words, toxic = [word() for _ in range(r.randrange(3, 120))], k % 4 == 0
        for _ in range(r.randrange(2, 6) if toxic else 0):
            words[r.randrange(len(words))] = r.choice(["dolt", "Oaf", "grubé" + word()])
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 0.0, "", 1) for k, t, _ in rows], SCHEMA).repartition(4)
    copies = [(9000 + k, rows[0][1], 0.0, "", 1) for k in range(40)]
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows if k % 3 != 1] + [(0, 1, 0), (None, 1, 1), (2, 0, None), (77777, 1, 1)] + [(c[0], 1, 1) for c in copies], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs.union(spark.createDataFrame(copies, SCHEMA)), labels), docs, rows


def test_held_out_accuracy(fitted):
    field, docs, rows = fitted
    want = {k: x for k, _, x in rows if k % 3 == 1}
    got = {r["doc_id"]: r for r in toxicity.scored(docs, field, ["doc_id"]).collect()}
    assert sum(got[k]["predicted"] == x for k, x in want.items()) / len(want) > 0.97
    texts = {k: t for k, t, _ in rows}
    said = [texts[k][s["start"] : s["end"]] for k in want for s in got[k]["spans"]]
    bad = [s for s in said if all(w.lower() in ("dolt", "oaf") or w.startswith("grubé") for w in s.split(" "))]
    assert len(bad) > 0.9 * len(said) and all(0 <= r["score"] <= 1 and r["n_tokens"] == len(texts[k].split(" ")) for k, r in got.items())


def test_edges(spark, fitted):
    field, _, rows = fitted
    odd = [None, "", "  ", "!?", rows[0][1], rows[0][1], "dolt " * 50_000, "x" * 300_000, "né\u0000né"]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(odd)] + [(None, "Oaf", None, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in toxicity.scored(docs, field, ["doc_id"]).collect()}
    assert len(got) == 10 and len({got[k]["score"] for k in range(4)}) == 1 and got[0]["spans"] == [] and got[4][1:] == got[5][1:]
    assert got[6]["predicted"] == 1 and [(s["start"], s["end"]) for s in got[6]["spans"]] == [(0, 249_999)] and got[7]["predicted"] == 0
    assert toxicity.scored(docs.limit(0), field, ["doc_id"]).count() == 0


def test_one_kind_of_label(spark):
    docs = spark.createDataFrame([(1, "a b c", 0.0, "", 1), (2, None, 0.0, "", 1)], SCHEMA)
    for given, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, 0)], 0.0)):
        field = toxicity.fit(docs, spark.createDataFrame(given, "doc_id long, toxic int"))
        assert {round(r["score"], 6) for r in toxicity.scored(docs, field, []).collect()} == {want}
