"""Main text of web pages by consensus host paths.

A page's containers are scored by the text they hold, less what stands in links and
in elements whose class, id or role speaks against them. The best one votes for its
path of tags and classes, with digits taken out, at its host, and every container
for or against being set aside: for it speak such words, and the same text on all
pages; against it half of the page's text, or its title. Spark counts the votes, and
each page is extracted again from the containers that have its host's winning path,
without those that its host sets aside. A page without that path is extracted from
its own best container. Only tags that are never text are left out without a vote.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import scratch

#: Bytes of hosts' paths up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Part of a page's text that the best container has to hold; part of what a page's own best one holds, below which the host's winner is not used.
ENOUGH, LITTLE = 0.7, 0.3
#: Part of a text in links from which on it isn't taken along with the best container.
LINKED = 0.3
#: Pages, and one in so many of the host's, that vote on a path before it is set aside or kept on all of them.
PAGES, PART_OF_HOST = 3, 1000
#: Containers deeper than that, and characters of a name beyond, don't tell paths apart.
DEPTH, NAME = 64, 100

# Tags of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article body center div main section table tbody td tr".split())
SKIPPED = frozenset("applet aside button canvas dialog footer form head iframe input menu nav noscript object option script select style svg template textarea title".split())
ENDS_P = BLOCK - {"body", "html"}
TITLES = frozenset("h1".split())
#: Words in a class, an id or a role that speak against an element, those that outweigh them, and those that nothing outweighs.
MAIN_WORDS = frozenset("article body content entry main post story text".split())
READER_WORDS = frozenset("comment comments disqus replies reply".split())
ASIDE_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promotion related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template|svg)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


class Part(NamedTuple):
    """A block of text: the names of the containers around it, the depths of those that words speak against, its characters in links, and whether it is a title."""

    path: tuple[str, ...]
    against: tuple[int, ...]
    text: str
    links: int
    title: bool


def speaks_against(marks: dict[str, str]) -> bool:
    words = {w for v in marks.values() for w in WORD.findall(v)}
    return not words.isdisjoint(ASIDE_WORDS) and (words.isdisjoint(MAIN_WORDS) or not words.isdisjoint(READER_WORDS))


def name_of(tag: str, marks: dict[str, str], against: bool) -> str:
    classes = "".join(f".{c}" for c in sorted(marks.get("class", "").split()))
    others = "".join(f"{sign}{marks[k]}" for sign, k in (("#", "id"), ("@", "role")) if against and k in marks)
    return re.sub("[0-9>]+", "", tag + classes + others)[:NAME]


def blocks(page: str) -> list[Part]:
    """Every block of a page that no tag sets aside, in page order."""
    found: list[Part] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, whether it sets its content aside, whether it is in the path
    path: list[str] = []
    against: list[int] = []
    text: list[str] = []
    aside = links = in_link = titles = at = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                found.append(Part(tuple(path[:DEPTH]), tuple(x for x in against if x < DEPTH), joined, links, titles > 0))
            text.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal aside, in_link, titles
        while len(open_) > depth:
            tag, hides, named = open_.pop()
            aside -= hides
            in_link -= tag == "a"
            titles -= tag in TITLES
            if named:
                path.pop()
                if against and against[-1] == len(path):
                    against.pop()

    def nearest(*tags: str) -> int | None:
        return next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] in tags), None)

    for m in TOKEN.finditer(page):
        if m.start() > at and not aside:
            piece = page[at : m.start()]
            text.append(piece)
            links += len(piece) if in_link else 0
        at = m.end()
        ending, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], "")
        if not tag:
            continue
        tag = tag.lower()
        marks = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes and not ending else {}
        marked = bool(marks) and tag not in ("html", "body", "article", "main") and speaks_against(marks)
        if tag in BLOCK or marked:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag in VOID:
            continue
        if ending:
            depth = nearest(tag)
            if depth is not None and (tag in BLOCK or all(open_[k][0] not in CONTAINER for k in range(depth, len(open_)))):
                if any(named for _, _, named in open_[depth:]):
                    flush()
                close(depth)
            continue
        if tag in ENDS_P:
            depth = nearest("p")
            if depth is not None and not any(t in CONTAINER for t, *_ in open_[depth:]):
                close(depth)
        if tag == "li" and (depth := nearest("li", "ul", "ol")) is not None and open_[depth][0] == "li":
            close(depth)
        hides = tag in SKIPPED or tag == "header" and not any(t in ("article", "main") for t, *_ in open_)
        named = tag in CONTAINER or marked
        open_.append((tag, hides, named))
        aside += hides
        in_link += tag == "a"
        titles += tag in TITLES
        if named:
            if marked:
                against.append(len(path))
            path.append(name_of(tag, marks, marked))
    if at < len(page) and not aside:
        text.append(page[at:])
    flush()
    return found


def worth(parts: list[Part]) -> int:
    return sum(max(0, len(p.text) - 2 * p.links) for p in parts)


def under(parts: list[Part], path: tuple[str, ...]) -> list[Part]:
    return [p for p in parts if p.path[: len(path)] == path]


def ballots(parts: list[Part]) -> list[tuple[tuple[str, ...], bool, bool, int]]:
    """(path, whether words speak against it, whether it has half of the page's text or its title, hash of its text) of every container below the page."""
    total = sum(len(p.text) for p in parts)
    texts: dict[tuple[str, ...], list[Part]] = {}
    spoken: set[tuple[str, ...]] = set()
    for p in parts:
        for k in range(1, len(p.path) + 1):
            texts.setdefault(p.path[:k], []).append(p)
        spoken.update(p.path[: k + 1] for k in p.against)
    return [(path, path in spoken, 2 * sum(len(p.text) for p in inner) >= total or any(p.title for p in inner), zlib.crc32("\n".join(p.text for p in inner).encode())) for path, inner in texts.items()]


def kept(parts: list[Part], keeps: frozenset = frozenset(), drops: frozenset = frozenset()) -> list[Part]:
    """The parts in no container that is set aside: by the host's vote, or else if words speak against it and it has neither half of the text nor a title."""
    gone = {path for path, spoken, big, _ in ballots(parts) if path in drops or spoken and not big and path not in keeps}
    return [p for p in parts if not any(p.path[:k] in gone for k in range(1, len(p.path) + 1))] if gone else parts


def best_path(parts: list[Part]) -> tuple[str, ...] | None:
    """The deepest container, but none below an article or main, with ENOUGH of the text that isn't links; null without text.

    From there it goes up as long as that adds a title, or, where there is neither
    article nor main, text with few links.
    """
    score: dict[tuple[str, ...], int] = {}
    for p in parts:
        value = max(0, len(p.text) - 2 * p.links) / (4 if p.against else 1)
        for k in range(len(p.path) + 1):
            score[p.path[:k]] = score.get(p.path[:k], 0) + value
    total = score.get((), 0)
    if not total:
        return None
    best = max((p for p, v in score.items() if v >= ENOUGH * total), key=lambda p: (len(p), p))
    semantic = [k for k, name in enumerate(best) if name.split(".")[0] in ("article", "main")]
    best = best[: semantic[-1] + 1] if semantic else best
    for k in range(len(best) - 1, -1, -1):
        more = [p for p in under(parts, best[:k]) if p.path[: len(best)] != best]
        if sum(p.links for p in more) > LINKED * sum(len(p.text) for p in more) or semantic and not any(p.title for p in more):
            break
        best = best[:k]
    return best


def main_text(parts: list[Part], winner: str | None, keeps: Iterable[str] = (), drops: Iterable[str] = ()) -> str:
    """The blocks under the winning path, or under the page's own best one where it has little there, joined by blank lines."""
    left = kept(parts, frozenset(map(named_path, keeps)), frozenset(map(named_path, drops)))
    own = best_path(left)
    if own is None:
        return ""
    chosen = under(left, own)
    if winner is not None:
        voted = under(left, named_path(winner))
        if worth(voted) >= LITTLE * worth(chosen):
            chosen = voted
    return "\n\n".join(p.text for p in chosen)


def named_path(path: str) -> tuple[str, ...]:
    return tuple(path.split(">")) if path else ()


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    return pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, winner, keeps and drops: the path with the most pages of each host (of equals, the last in order), and the paths that it keeps or sets aside on all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "path", "best", "against", "big", "text"]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = blocks(page)
                if (best := best_path(kept(parts))) is not None:
                    rows.append((host, ">".join(best), True, 0, 0, 0))
                rows += [(host, ">".join(path), False, int(spoken), int(big), text) for path, spoken, big, text in ballots(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names)

    votes = pages.select("host", "html").mapInArrow(run, "host string, path string, best boolean, against int, big int, text long")
    counted = votes.groupBy("host", "path", "best").agg(F.count("*").alias("n"), F.sum("against").alias("against"), F.sum("big").alias("big"), (F.min("text") == F.max("text")).alias("same"))
    counted = scratch.written(counted, "path-votes")
    best = counted.where("best").groupBy("host").agg(F.max_by("path", F.struct("n", "path")).alias("winner"), F.sum("n").alias("pages"))
    support = counted.where(f"not best and n >= {PAGES}").join(best.select("host", "pages"), "host").where(f"n * {PART_OF_HOST} >= pages")
    big = F.col("big") * 2 >= F.col("n")
    judged = support.withColumn("drop", ~big & ((F.col("against") * 2 >= F.col("n")) | F.col("same"))).withColumn("keep", big & (F.col("against") > 0))
    lists = judged.groupBy("host").agg(*(F.collect_list(F.when(F.col(c), F.col("path"))).alias(f"{c}s") for c in ("keep", "drop")))
    return best.drop("pages").join(lists, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages`` (page_id, url, html).

    A null or empty html has an empty text, and so has a page of links; a null url,
    or one without a host, votes with the others of that kind. Repeated rows vote
    and are extracted each; an empty table gives no rows; other columns are not read.
    """
    hosted = with_host(pages)
    joined = hosted.join(_small(host_paths(hosted)), "host", "left").select("page_id", "url", "winner", "keeps", "drops", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(blocks(x), w, k or (), d or ()) for w, k, d, x in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, pages.select("page_id").schema.add("url", "string").add("text", "string").add("n_chars", "long"))


def _small(paths: DataFrame) -> DataFrame:
    """The hosts' paths as a table, marked for broadcast if their bytes are few."""
    table = scratch.written(paths, "host-paths")
    shown = F.concat_ws("", "host", "winner", "keeps", "drops")
    size = table.agg(F.sum(F.octet_length(shown) + 64)).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op6_html": op6_html}
SQL: dict[str, str] = {}
