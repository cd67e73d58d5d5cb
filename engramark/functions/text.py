"""Column functions over surface forms, text and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that, as one extra last word, change a relation's direction.
TRAILING_WORDS = ("by", "of", "for", "to", "in", "on", "at", "with", "from", "as", "into", "over", "under", "about", "through", "via")
# Fixed value: the scale of the discount sequence.
GAMMA_SCALE = 0.4412


def tokens(x: Column | str) -> Column:
    """Lower-case words of a name, split at case changes, acronym ends, ``_``, ``-`` and white space."""
    x = F.regexp_replace(F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.translate(x, "_-", "  ")), r"\s+"), lambda t: t != "")


def token_key(x: Column | str) -> Column:
    """The multiset of a name's tokens as one string."""
    return F.array_join(F.array_sort(tokens(x)), " ")


def token_bucket(token: Column | str) -> Column:
    """Bucket of a token among 4096, from the end of its SHA-256."""
    return F.conv(F.right(F.sha2(F.col(token) if isinstance(token, str) else token, 256), F.lit(3)), 16, 10).cast("int")


def token_sign(token: Column | str) -> Column:
    """1 or -1: the ninth-last bit of a token's SHA-256."""
    digit = F.substring(F.sha2(F.col(token) if isinstance(token, str) else token, 256), 62, 1)
    return F.when(F.conv(digit, 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)


def weighted_cosine(one: Column, two: Column, weights: tuple[float, float] = (2.0, 1.0)) -> Column:
    """Cosine of two joined vectors from the cosines of their parts, both of which are there."""
    a, b = (w * w for w in weights)
    return (a * one + b * two) / (a + b)


def normalized(vector: Column | str) -> Column:
    """A vector over its length; one of zeros stays as it is."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def words(x: Column | str) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.translate(x, "_-", "  ")), r"\s+", " ")), " ")


def digits_differ(a: str, b: str) -> Column:
    return F.regexp_extract_all(F.col(a), F.lit(r"(\d+)"), F.lit(1)) != F.regexp_extract_all(F.col(b), F.lit(r"(\d+)"), F.lit(1))


def trailing_word_differs(a: str, b: str) -> Column:
    """Whether one name is the other with exactly one more word, a function word, at its end."""

    def extends(long: Column, short: Column) -> Column:
        return (F.size(long) == F.size(short) + 1) & (F.slice(long, 1, F.size(short)) == short) & F.element_at(long, -1).isin(*TRAILING_WORDS)

    one, two = words(a), words(b)
    return extends(one, two) | extends(two, one)


def merge_allowed(a: str, b: str) -> Column:
    return ~(digits_differ(a, b) | trailing_word_differs(a, b))


def stub_bucket(x: Column | str) -> Column:
    """One of 34 labels by the SHA-256 of a name, as a number modulo 34."""
    hexes = F.filter(F.split(F.sha2(F.col(x) if isinstance(x, str) else x, 256), ""), lambda c: c != "")
    folded = F.aggregate(hexes, F.lit(0), lambda a, d: (a * 16 + F.conv(d, 16, 10).cast("int")) % 34)
    return F.concat(F.lit("BUCKET_"), F.lpad(folded.cast("string"), 2, "0"))


def utility(days: Column, queries: Column, decay: float) -> Column:
    return F.exp(-decay * days) * (1 + F.log1p(queries))


def discount(n: Column) -> Column:
    return GAMMA_SCALE / (n * F.pow(F.log2(n + 1), F.lit(2)))


def cosine(a: str, b: str) -> Column:
    """Dot product of two arrays over the product of their norms; 0 if either is zero."""

    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) fixed by its parts, the same in any engine that has SHA-256."""
    joined = F.concat_ws(":", *(F.lit(p) if isinstance(p, (int, str)) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("double") / 4294967296.0


def list_items(x: Column | str) -> Column:
    """Items of an answer given as lines or commas, without numbering, each once."""
    lines = F.transform(F.split(x, r"[\n,]"), lambda s: F.trim(F.regexp_replace(s, r"^\s*(\d+[.)]|[-*])\s*", "")))
    return F.array_distinct(F.filter(lines, lambda s: s != ""))
