"""Language identification by compression.

Each language has a zstandard raw-content dictionary made of labelled texts. A
text, reduced to its lower-cased letters, is cut into chunks, each chunk is
compressed with every dictionary, and the language whose dictionary gives the fewest bytes over the whole text is chosen.
A text whose two smallest sizes are close is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of the fit: labelled rows for each language, and bytes of the stretch that each gives to the dictionary.
ROWS_PER_LANGUAGE = 200
BYTES_PER_ROW = 560
#: Languages whose dictionaries a task holds at once; more are tried in further rounds.
LANGUAGES_AT_ONCE = 64
#: Hash values that doc_ids are spread over to bound what is sorted.
HASHES = 1 << 30
CHUNK = 512
LEVEL = 6
#: A text is rejected if the second smallest size is larger by less than this part of it.
MIN_MARGIN = 0.004
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The lower-cased letters of a text, with one space for each run of anything else."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def learn(labelled: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Iterator[dict[str, bytes]]:
    """Dictionaries by language, the most frequent first, from (doc_id, text, lang) rows, LANGUAGES_AT_ONCE at a time.

    ``rows`` rows of a language are read at most, those with the smallest hashes of
    doc_id, a stretch of BYTES_PER_ROW bytes of each, from a place that its hash
    draws; all of it goes into the dictionary. Rows with a null in any of the three
    columns teach nothing, and without rows there is no dictionary. Every language
    gets one; the driver holds their names, and those of one block.
    """
    usable = labelled.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null")
    counts = [(r["lang"], r["count"]) for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    for k in range(0, len(counts), LANGUAGES_AT_ONCE):
        yield _dictionaries(usable, counts[k : k + LANGUAGES_AT_ONCE], rows)


def _dictionaries(usable: DataFrame, counts: list[tuple[str, int]], rows: int) -> dict[str, bytes]:
    # Of a frequent language only the hashes below a bound are sorted, about four times as many as are taken.
    bound = F.lit(0)
    for lang, n in counts:
        bound = F.when(F.col("lang") == lang, F.lit(max(1, HASHES * 4 * rows // n))).otherwise(bound)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = usable.select("doc_id", "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < bound).distinct()
    ids = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).drop("k")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.octet_length("text") - BYTES_PER_ROW)).cast("int")
    part = F.substring(F.encode("text", "UTF-8"), start + 1, F.lit(BYTES_PER_ROW)).alias("part")
    # A doc_id with several texts gives its smallest, so that the bound holds.
    chosen = usable.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "doc_id", part).groupBy("lang", "doc_id").agg(F.min("part").alias("part"))
    parts: dict[str, list[bytes]] = {lang: [] for lang, _ in counts}
    for r in chosen.orderBy("lang", "doc_id").collect():
        parts[r["lang"]].append(letters(bytes(r["part"]).decode(errors="ignore")))
    return {lang: b"".join(x) for lang, x in parts.items()}


def identify(docs: DataFrame, dictionaries: Iterable[dict[str, bytes]], keep: list[str] = [], min_margin: float = MIN_MARGIN) -> DataFrame:  # noqa: B006
    """Adds lang_pred, score and rejected to the columns ``keep`` of ``docs``, from the column text alone.

    score is the margin, the part by which the smallest size is below the second
    smallest; it is 1 with a single language. A null text and one without a letter
    are ``und`` with score 0, and rejected; with no dictionary all texts are. Ties
    go to the more frequent language. Repeated rows give repeated results, an empty
    table none; columns named as added ones are not to be kept.
    """
    now = docs.select(*keep, F.col("text").cast("string").alias("_text_to_judge"), F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("long").alias("_first"), F.lit(None).cast("long").alias("_second"))
    for block in dictionaries:
        now = _round(now, block)
    judged = F.col("_lang").isNotNull()
    score = F.when(judged, F.when(F.col("_second").isNull(), 1.0).otherwise(1 - F.col("_first") / F.col("_second"))).otherwise(0.0)
    return now.select(*keep, F.coalesce("_lang", F.lit(UNDETERMINED)).alias("lang_pred"), score.alias("score"), (~judged | (score < min_margin)).alias("rejected"))


def _round(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """docs with _lang, _first and _second as they are after these languages: that of the smallest size, the smallest and the second smallest size."""
    given = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = list(given.value)
        coders = []
        for name in names:
            content = zstandard.ZstdCompressionDict(given.value[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False).compress)
        for batch in batches:
            columns: list[list] = [[], [], []]
            for value, *before in zip(*(batch.column(k) for k in range(batch.num_columns - 4, batch.num_columns)), strict=True):
                text, (lang, first, second) = value.as_py(), (x.as_py() for x in before)
                if names and text is not None and LETTER.search(text):
                    raw = memoryview(letters(text))
                    chunks = [raw[k : k + CHUNK] for k in range(0, len(raw), CHUNK)]
                    for name, coder in zip(names, coders, strict=True):
                        size = sum(len(coder(c)) for c in chunks)
                        if first is None or size < first:
                            lang, first, second = name, size, first
                        elif second is None or size < second:
                            second = size
                for column, x in zip(columns, (lang, first, second), strict=True):
                    column.append(x)
            found = (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *found], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; rows of fold 2 are held out of the fit. A null doc_id is in no fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = identify(docs, learn(docs.where(fold() != 2)), ["doc_id"])
    return judged.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_language": op7_language}
SQL: dict[str, str] = {}
