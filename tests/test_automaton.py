"""The automaton against alternations of regular expressions."""

import random
import re
import time

import pytest

from engramark.operators import automaton, mentions


def alternation(aliases, bounded):
    either = "|".join(re.escape(a) for a in sorted(aliases, key=lambda a: (-len(a), a)) if a)
    return re.compile(rf"\b(?:{either})\b" if bounded else either)


@pytest.mark.parametrize("bounded", [False, True])
def test_same_as_alternation(bounded):
    r = random.Random(1)
    for _ in range(300):
        aliases = {"".join(r.choice("abé -") for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 12))}
        text = "".join(r.choice("abé -_") for _ in range(r.randrange(60)))
        found = automaton.Automaton([*aliases, ""])
        assert found.leftmost(text, bounded) == [m.span() for m in alternation(aliases, bounded).finditer(text)]
        every = sorted((m.start(), m.start() + len(a)) for a in aliases for m in re.finditer(f"(?={re.escape(a)})", text))
        assert sorted(found.every(text)) == every
        each = sorted(m.span() for a in aliases for m in re.finditer(rf"\b{re.escape(a)}\b" if bounded else re.escape(a), text))
        if not bounded:
            assert found.by_alias(text) == each


def test_many_aliases(spark):
    """100,000 aliases, of which texts hold some: the same as looking for those that they may hold."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    aliases = {}
    while len(aliases) < 100_000:
        a = " ".join(word() for _ in range(r.randrange(1, 4)))
        aliases[a] = f"<{len(aliases)}>"
    names = list(aliases)
    texts = [" ".join(r.choice((word(), r.choice(names))) for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] + [(200, None, 0), (201, "", 0)], "id int, text string, matches int")
    for bounded in (False, True):
        began = time.time()
        got = {x["id"]: x["normalized"] for x in mentions.substituted(df, "text", aliases, bounded).collect()}
        took = time.time() - began
        assert got[200] is None and got[201] == "" and took < 60
        for k, t in enumerate(texts):
            some = {a for a in aliases if a[:3] in t and a in t}
            assert got[k] == (alternation(some, bounded).sub(lambda m: aliases[m[0]], t) if some else t)


def test_matches(spark, monkeypatch):
    df = spark.createDataFrame([("né new york",), (None,)], "text string")
    assert [x["matches"] for x in automaton.matches(df, "text", ["new", "new york", "é"]).collect()] == [[(1, 2, "é"), (3, 11, "new york")], None]
    assert [x["matches"] for x in automaton.matches(df, "text", [], True).collect()] == [[], None]
    table = spark.createDataFrame([("a",), ("a",), (None,), ("",), ("b",)], "alias string")
    assert sorted(automaton.known(table)) == ["a", "b"]
    monkeypatch.setattr(automaton, "MOST_ALIASES", 1)
    with pytest.raises(ValueError, match="aliases"):
        automaton.known(table)
