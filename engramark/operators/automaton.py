"""Many aliases at once: one automaton over all of them goes through a text once, however many there are.

An automaton is a trie with a link from each state to the longest proper suffix that
the trie has too. Its matches are thinned out to the leftmost, of one start the
longest, that don't overlap: what an alternation of the aliases, the longest first, would match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aliases at most: their automaton goes to every task.
MOST_ALIASES = 1_000_000
MATCH = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("alias", "string"))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("alias", pa.string())]))


class Automaton:
    """The aliases' states, in the order of breadth: moves by character, the link on a mismatch, and the lengths of the aliases that end there."""

    def __init__(self, aliases: Iterable[str]) -> None:
        self.moves: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, ...]] = [()]
        for alias in sorted(set(aliases) - {""}):
            state = 0
            for c in alias:
                after = self.moves[state].get(c)
                if after is None:
                    after = self.moves[state][c] = len(self.moves)
                    self.moves.append({})
                    self.ends.append(())
                state = after
            self.ends[state] = (len(alias),)
        self.link = [0] * len(self.moves)
        level = list(self.moves[0].values())
        while level:
            following = []
            for state in level:
                for c, after in self.moves[state].items():
                    back = self.link[state]
                    while back and c not in self.moves[back]:
                        back = self.link[back]
                    self.link[after] = self.moves[back].get(c, 0)
                    # Links lead to shorter strings, which have their ends already.
                    self.ends[after] += self.ends[self.link[after]]
                    following.append(after)
            level = following

    def every(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every place of every alias, by end."""
        moves, link, ends, state = self.moves, self.link, self.ends, 0
        for i, c in enumerate(text, 1):
            after = moves[state].get(c)
            while after is None and state:
                state = link[state]
                after = moves[state].get(c)
            state = after or 0
            for n in ends[state]:
                yield i - n, i

    def leftmost(self, text: str, bounded: bool = False) -> list[tuple[int, int]]:
        """(start, end) of the matches that don't overlap: always the leftmost, of one start the longest; only at word bounds if ``bounded``."""
        found = [m for m in self.every(text) if not bounded or (at_bound(text, m[0]) and at_bound(text, m[1]))]
        out, last = [], 0
        for start, end in sorted(found, key=lambda m: (m[0], -m[1])):
            if start >= last:
                out.append((start, end))
                last = end
        return out

    def by_alias(self, text: str, bounded: bool = False) -> list[tuple[int, int]]:
        """(start, end) of the matches of each alias that don't overlap others of the same alias."""
        last: dict[str, int] = {}
        out = []
        for start, end in sorted(self.every(text)):
            if (not bounded or (at_bound(text, start) and at_bound(text, end))) and start >= last.get(text[start:end], 0):
                out.append((start, end))
                last[text[start:end]] = end
        return out


def at_bound(text: str, i: int) -> bool:
    """Whether a word begins or ends before the character at i."""
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    return word(i - 1) != word(i)


def known(aliases: DataFrame, column: str = "alias") -> list[str]:
    """The different aliases of a table, without empty ones; more than MOST_ALIASES are an error."""
    found = [r[0] for r in aliases.select(column).where(F.col(column) != "").distinct().limit(MOST_ALIASES + 1).collect()]
    if len(found) > MOST_ALIASES:
        raise ValueError(f"an automaton has at most {MOST_ALIASES} aliases")
    return found


def mapped(df: DataFrame, column: str, out: str, kind: T.DataType, arrow: pa.DataType, aliases: list[str], f: Callable[[Automaton, str], object]) -> DataFrame:
    """df with ``out``, f of the aliases' automaton and a string column; nulls stay null."""
    at, names = df.columns.index(column), [*df.columns, out]
    given = df.sparkSession.sparkContext.broadcast(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(given.value)
        for batch in batches:
            values = [None if x is None else f(automaton, x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, arrow)], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def matches(df: DataFrame, column: str, aliases: list[str], bounded: bool = False) -> DataFrame:
    """df with matches: array of (start, end, alias), in code points, leftmost-longest."""
    return mapped(df, column, "matches", MATCH, _ARROW, aliases, lambda a, x: [{"start": s, "end": e, "alias": x[s:e]} for s, e in a.leftmost(x, bounded)])


def substituted(df: DataFrame, column: str, aliases: dict[str, str], bounded: bool = False) -> DataFrame:
    """df with normalized: every match replaced by its canonical form, in one pass; without aliases the text as it is."""
    canonical = df.sparkSession.sparkContext.broadcast(aliases)

    def replaced(automaton: Automaton, x: str) -> str:
        out, last = [], 0
        for start, end in automaton.leftmost(x, bounded):
            out += [x[last:start], canonical.value[x[start:end]]]
            last = end
        return "".join([*out, x[last:]])

    return mapped(df, column, "normalized", T.StringType(), pa.string(), [a for a in aliases if a], replaced)
