"""The ranges that sorting finds in a group of segments, against all windows."""

import random

import pytest

from engramark.llm.anchors import GRAM
from engramark.llm.suffix_dedup import matches

LENGTH = 100


def covered(group):
    found = []
    for i, (s, a) in enumerate(group):
        hit = []
        for at in range(len(s) - LENGTH + 1):
            window = s[at : at + LENGTH]
            if any(j != i and b - a + at >= 0 and t[b - a + at : b - a + at + LENGTH] == window for j, (t, b) in enumerate(group)):
                hit.append(at)
        found.append((min(hit), max(hit) + LENGTH) if hit else None)
    return found


def changed(draw, letters, base, size, end):
    """A suffix or prefix of one of two strings, with a byte changed now and then."""
    s = bytearray(base[draw.randint(0, 1)][::-1][:size] if end else base[draw.randint(0, 1)][:size])
    if s and draw.random() < 0.3:
        s[draw.randrange(len(s))] = draw.choice(letters)
    return bytes(s[::-1] if end else s)


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc"])
def test_matches_of_random_groups(letters):
    draw = random.Random(letters[-1])
    gram, side = bytes(draw.choices(b"xyz", k=GRAM)), LENGTH - GRAM
    base = [bytes(draw.choices(letters, k=side)) for _ in range(2)]
    some = 0
    for _ in range(40):
        group = set()
        for _ in range(draw.randint(2, 14)):
            left = changed(draw, letters, base, draw.randint(0, side), True)
            group.add((left + gram + changed(draw, letters, base, draw.randint(side - len(left), side), False), len(left)))
        group = sorted(group)
        expected = covered(group)
        assert matches(group, LENGTH) == expected
        some += sum(x is not None for x in expected)
    assert some > 40
