"""The static embedder against plain Python."""

import math
import random
import re

import pytest

from engramark.operators import embedding

PIECES = ["a", "b", "c", "ab", "abc", "ring", "r", "##a", "##b", "##ab", "##c", "##ing", "##r", "the", "##", "-", "é", "##é"]


def cut(word, known=frozenset(PIECES)):
    out, at = [], 0
    while at < len(word):
        end = max((e for e in range(at + 1, len(word) + 1) if ("##" if at else "") + word[at:e] in known and not (at == 0 and word[:e].startswith("##") and e > 2)), default=0)
        if not end:
            return ["[UNK]"]
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def words(text):
    return re.findall(r"[^\s!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]", text.lower())


@pytest.fixture(scope="module")
def vocabulary(spark):
    r = random.Random(1)
    rows = [(p, [r.gauss(0, 1) for _ in range(5)]) for p in PIECES]
    return rows, spark.createDataFrame([*rows, ("a", [99.0] * 5), (None, [1.0] * 5), ("zz", None)], "piece string, vector array<double>")


def test_longest_match():
    trie = embedding.Trie(PIECES)
    r = random.Random(2)
    for _ in range(2000):
        word = "".join(r.choice("abcringé-") for _ in range(r.randrange(1, 8)))
        assert trie.cut(word) == cut(word)


def test_embedded(spark, vocabulary):
    rows, table = vocabulary
    vectors = {p: v for p, v in rows} | {"a": min(rows[0][1], [99.0] * 5)}
    r = random.Random(3)
    texts = ["", " ", "zzz", "Ring ring", "AB-c é", *(" ".join("".join(r.choice("abcr") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(4))) for _ in range(40))]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate([*texts, texts[3], None])], "id int, name string, piece int")
    for template in ("{}", "the {} ring"):
        got = {x["id"]: (x["name"], x["vector"]) for x in embedding.embedded(df, "name", table, template).collect()}
        assert len(got) == len(texts) + 2 and got[len(texts) + 1] == (None, None)
        for k, t in enumerate([*texts, texts[3]]):
            found = [vectors[p] for w in words(template.format(t)) for p in cut(w) if p in vectors]
            sums = [sum(c) for c in zip(*found, strict=True)] or [0.0] * 5
            norm = math.sqrt(sum(x * x for x in sums)) or 1.0
            assert got[k][1] == pytest.approx([x / norm for x in sums], abs=1e-12)
    assert embedding.embedded(df.limit(0), "name", table).count() == 0


def test_pieces(spark, vocabulary, monkeypatch):
    df = spark.createDataFrame([("abc ring", 1), (None, 2), ("x", 3)], "name string, vector int")
    assert [x["pieces"] for x in embedding.pieces(df, "name", vocabulary[1]).orderBy("vector").collect()] == [["abc", "ring"], [], ["[UNK]"]]
    monkeypatch.setattr(embedding, "MOST_PIECES", 3)
    with pytest.raises(ValueError, match="pieces"):
        embedding.pieces(df, "name", vocabulary[1])
