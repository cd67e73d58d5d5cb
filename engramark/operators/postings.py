"""A positional index of strings of Q characters, for words that may stand anywhere in a text, also inside other words.

A posting says at which place of which text a string stands. A word is looked up by
two of its strings, the rarest and the one farthest from it, whose places must differ as they do in
the word; what is left is verified. Words of fewer than Q characters match by the
beginnings of strings, for which texts end with Q - 1 marks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramark.operators.graph import reliable, stored

Q = 3
#: Fills up the ends of texts; no word has it.
MARK = "￿"
#: Parts of the texts, in order, after which questions that have their first texts are left alone; the last is all.
PARTS = (1 / 64, 1 / 8, 1.0)


def postings(texts: DataFrame) -> DataFrame:
    """(gram, id, seq, place) of lower-cased texts (id, seq, text): every string of Q characters with its place from 1; nulls have none."""
    # Cut into characters once: taking each string out of the text would go through it from its start every time.
    cut = texts.select("id", "seq", F.split(F.concat(F.lower("text"), F.lit(MARK * (Q - 1))), "").alias("c")).where(F.size("c") >= Q)
    placed = cut.select("id", "seq", "c", F.explode(F.sequence(F.lit(1), F.size("c") - (Q - 1))).alias("place"))
    return placed.select(F.concat(*(F.get("c", F.col("place") + (k - 1)) for k in range(Q))).alias("gram"), "id", "seq", "place")


def content_words(questions: DataFrame, stopwords: tuple[str, ...]) -> DataFrame:
    """(question, word): the different lower-case words of questions (question, body) of more than one character that aren't stopwords."""
    words = questions.select("question", F.explode(F.split(F.lower("body"), r"\s+")).alias("word"))
    return words.where((F.length("word") > 1) & ~F.col("word").isin(*stopwords)).distinct()


def _grams(word: Column) -> Column:
    """(gram, offset) of a word's strings, or of the word itself if it is shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(word) - Q))
    return F.transform(starts, lambda o: F.struct(F.substring(word, o + 1, F.lit(Q)).alias("gram"), o.alias("offset")))


def chosen(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, gram, offset, second, apart): each word's rarest string by how often it stands in the texts, and the farthest other one; a shorter word has no second."""
    each = words.select("word", F.explode(_grams(F.col("word"))).alias("g")).select("word", "g.gram", "g.offset")
    wanted = each.select("gram").distinct()
    found = postings(texts).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rated = each.join(found, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = rated.groupBy("word").agg(F.min(F.struct("df", "offset", "gram")).alias("b")).select("word", F.col("b.gram").alias("gram"), F.col("b.offset").alias("offset"))
    last = F.length("word") - Q
    other = F.when(F.col("offset") * 2 < last, last).otherwise(0)
    x = best.withColumn("apart", F.when((F.length("word") > Q) & (other != F.col("offset")), other - F.col("offset")))
    return x.withColumn("second", F.when(F.col("apart").isNotNull(), F.substring(F.col("word"), F.col("offset") + F.col("apart") + 1, F.lit(Q))))


def _held(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(word, id, seq) of the texts that hold each of the chosen() words, once. Postings are made only of strings that the words are looked up by."""
    every = postings(texts)
    long = words.where(F.length("word") >= Q)
    wanted = long.select("gram").union(long.where("second is not null").select("second")).distinct()
    index = stored(every.join(wanted, "gram", "left_semi"))
    one = index.join(long.select("gram", "word", "offset", "second", "apart"), "gram").select("word", "id", "seq", (F.col("place") - F.col("offset")).alias("start"), "second", (F.col("place") + F.col("apart")).alias("then"))
    lone, two = one.where("second is null"), one.where("second is not null")
    both = two.join(index.select(F.col("gram").alias("second"), "id", F.col("place").alias("then")), ["second", "id", "then"])
    short = words.where(F.length("word") == 2).select("word")
    begun = every.select(F.left("gram", F.lit(2)).alias("word"), "id", "seq").join(short, "word", "left_semi")
    places = reduce(DataFrame.union, [x.select("word", "id", "seq") for x in (lone, both)])
    # Two strings of a longer word may stand right without the rest of it.
    sure = F.length("word") <= Q + 1
    open_ = places.where(~sure).distinct().join(texts.select("id", F.lower("text").alias("t")), "id").where(F.contains("t", F.col("word")))
    return reduce(DataFrame.union, [places.where(sure), begun]).distinct().union(open_.select("word", "id", "seq"))


def first_holding(words: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """(word, id, seq): the first ``top`` texts (id, seq, text) by (seq, id) that hold each word of two characters or more."""
    return _first(words.select(F.col("word").alias("question"), "word"), texts, top).select(F.col("question").alias("word"), "id", "seq")


def _first(asked: DataFrame, texts: DataFrame, top: int) -> DataFrame:
    """(question, id, seq): the first ``top`` texts (id, seq, text) by (seq, id) that hold any of each question's words; asked is (question, word), words of two characters or more.

    The texts are gone through in growing parts of their order. A question that has its
    first texts in a part is done, so that only those of rare words go through all of them. A
    part is written once; its own counts say by which strings words are looked up.
    """
    spark = texts.sparkSession
    open_, out = reliable(asked.distinct()), None
    ends = texts.agg(F.percentile_approx("seq", list(PARTS[:-1]), 1000)).first()[0] or []
    bounds = [None, *ends, None]
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = texts
        if low is not None:
            part = part.where(F.col("seq") > low)
        if high is not None:
            part = part.where(F.col("seq") <= high)
        part = stored(part.where("text is not null").repartition(2 * spark.sparkContext.defaultParallelism, "id"))
        held = _least(_held(reliable(chosen(open_.select("word").distinct(), part)), part), "word", top)
        met = held.join(open_, "word").select("question", "id", "seq").distinct()
        out = reliable(_least(met if out is None else out.union(met), "question", top))
        done = out.groupBy("question").agg(F.count("*").alias("n")).where(F.col("n") >= top).select("question")
        open_ = reliable(open_.join(done, "question", "left_anti"))
        if open_.isEmpty():
            break
    return out


def _least(found: DataFrame, of: str, top: int) -> DataFrame:
    """Of every value of the column ``of`` the first ``top`` rows by (seq, id)."""
    order = Window.partitionBy(of).orderBy("seq", "id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top).drop("_r")


def retrieved(questions: DataFrame, texts: DataFrame, stopwords: tuple[str, ...], top: int) -> DataFrame:
    """(question, id, r): the first ``top`` texts by (seq, id) that hold any content word of each question, r their place from 1. A question of stopwords finds none."""
    found = _first(content_words(questions, stopwords), texts, top)
    return found.select("question", "id", F.row_number().over(Window.partitionBy("question").orderBy("seq", "id")).alias("r"))
