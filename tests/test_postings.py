"""The positional index against looking into every text."""

import random

import pytest

from engramark.operators import postings
from engramark.plans.decisions import STOPWORDS

TEXTS = "id long, seq long, text string, gram string, word int"


def corpus(seed=1, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 7)))
    rows = [(k, r.randrange(90), r.choice((" ", "-")).join(word() for _ in range(r.randrange(0, 12))).upper() if k % 5 == 0 else " ".join(word() for _ in range(r.randrange(0, 12)))) for k in range(n)]
    rows += [(n, 3, None), (n + 1, 4, ""), (n + 2, 5, "a"), (n + 3, 5, "ab"), (n + 4, 5, "aabaab abaaab")]
    words = {word() for _ in range(60)} | {"ab", "aba", "aab", "aabaab", "zzz", "zz", "abab", "baab"}
    return rows, {w for w in words if len(w) > 1}


@pytest.mark.parametrize("parts", [(1 / 64, 1 / 8, 1.0), (1.0,)])
def test_first_holding(spark, parts, monkeypatch):
    monkeypatch.setattr(postings, "PARTS", parts)
    rows, words = corpus()
    texts = spark.createDataFrame([(*x, "", 0) for x in rows], TEXTS)
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    for top in (3, 1000) if len(parts) > 1 else (3,):
        got = {}
        for x in postings.first_holding(asked, texts, top).collect():
            got.setdefault(x["word"], []).append((x["seq"], x["id"]))
        want = {w: sorted((s, i) for i, s, t in rows if t and w in t.lower())[:top] for w in words}
        assert {w: sorted(x) for w, x in got.items()} == {w: x for w, x in want.items() if x}


def test_retrieved(spark):
    rows, words = corpus(2)
    texts = spark.createDataFrame([(*x, "", 0) for x in rows], TEXTS)
    r = random.Random(3)
    questions = [(k, " ".join(r.choice(sorted(words) + list(STOPWORDS)) for _ in range(r.randrange(1, 5))).title()) for k in range(25)] + [(90, "tell me a"), (91, ""), (92, None), (93, "  aab\n b ")]
    got = {(x["question"], x["id"]): x["r"] for x in postings.retrieved(spark.createDataFrame(questions, "question int, body string"), texts, STOPWORDS, 4).collect()}
    want = {}
    for k, q in questions:
        content = [w for w in (q or "").lower().split() if len(w) > 1 and w not in STOPWORDS]
        hits = sorted((s, i) for i, s, t in rows if t and any(w in t.lower() for w in content))
        want |= {(k, i): n for n, (_, i) in enumerate(hits[:4], 1)}
    assert got == want and want


def test_no_texts(spark):
    texts = spark.createDataFrame([], TEXTS)
    assert postings.first_holding(spark.createDataFrame([("ab",)], "word string"), texts, 3).count() == 0


def test_a_done_question_takes_its_rare_words_no_further(spark, monkeypatch):
    # Each word used to go through all texts until it had its own first ones, however many its question had.
    parts, chosen = [], postings.chosen
    monkeypatch.setattr(postings, "chosen", lambda words, texts: parts.append((sorted(x["word"] for x in words.collect()), texts.count())) or chosen(words, texts))
    texts = spark.createDataFrame([(k, k, f"common {'rare ' if k == 990 else ''}text", "", 0) for k in range(1000)], TEXTS)
    questions = spark.createDataFrame([(1, "common rare"), (2, "rare nowhere")], "question int, body string")
    got = sorted((x["question"], x["id"], x["r"]) for x in postings.retrieved(questions, texts, STOPWORDS, 3).collect())
    assert got == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 990, 1)]
    assert parts[0][0] == ["common", "nowhere", "rare"] and all(words == ["nowhere", "rare"] for words, _ in parts[1:])
    # The parts are cut from one another: each text is gone through once.
    assert len(parts) == 3 and sum(n for _, n in parts) == 1000
