"""WARC archives that store each payload once.

A payload's strong digest (SHA-256) addresses it: of records with equal payloads
the one with the smallest id is a response, which holds the bytes, and the others
are revisits, which hold headers only. Reading takes the archives apart into exact
record headers and a payload store keyed by a digest that is computed again from
the bytes and compared; joins rebuild the original records.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import scratch

#: Payloads of fewer bytes are always stored, as a revisit would be as long.
MIN_SHARED_BYTES = 100
#: Bytes of records after which a file ends.
FILE_BYTES = 64 << 20
#: Bytes of a file that are inflated at once, and of payloads in a batch.
CHUNK = 256 << 10
BATCH = 8 << 20
#: Fixed value of the format.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def planned(pages: DataFrame, min_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """page_id, url and payload of every row, with payload_digest and refers_to, the page_id that a revisit refers to or null.

    Rows with a null page_id refer to an equal payload with an id, if there is one,
    and are responses otherwise; rows that repeat the smallest id are responses.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    keyed = keyed.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    long = keyed.where(F.octet_length("payload") >= min_bytes).select("page_id", "payload_digest")
    original = long.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")
    revisits = long.distinct().join(original, "payload_digest").where("page_id is null or page_id <> original").withColumnRenamed("page_id", "revisit_id").withColumnRenamed("payload_digest", "digest")
    on = F.col("page_id").eqNullSafe(F.col("revisit_id")) & (F.col("payload_digest") == F.col("digest"))
    return keyed.join(revisits, on, "left").select("page_id", "url", "payload", "payload_digest", F.col("original").alias("refers_to"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_SHARED_BYTES) -> None:
    """Writes gzip-compressed WARC 1.1 files to ``path``, a record for every row; null html is an empty payload, a null url no header."""

    def header(name: str, value: F.Column | str) -> F.Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))

    def urn(page_id: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")), F.lit(">"))

    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn("page_id")),
        F.when(target.isNotNull(), header("WARC-Target-URI", target)).otherwise(""),
        header("WARC-Date", "1970-01-01T00:00:00Z"),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(header("WARC-Profile", IDENTICAL), header("WARC-Refers-To", urn("refers_to")))).otherwise(""),
        header("Content-Type", "application/http; msgtype=response"),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
        F.lit("\r\n\r"),  # the writer of lines adds the last \n
    )
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = 0
        for batch in batches:
            sizes = [len(x.as_buffer() or b"") for x in batch.column(0)]
            files = []
            for size in sizes:
                files.append(held // FILE_BYTES)
                held += size
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.int64())], ["value", "file"])

    records = planned(pages, min_bytes).select(record.alias("value")).mapInArrow(numbered, "value string, file long")
    records.write.partitionBy("file").option("compression", "gzip").option("lineSep", "\n").text(path)


def inflated(raw: bytes) -> Iterator[bytes]:
    """The content of a gzip file, of one member or of many after each other, in pieces."""
    view, member = memoryview(raw), None
    for at in range(0, len(view), CHUNK):
        rest = bytes(view[at : at + CHUNK])
        while rest:
            member = member or zlib.decompressobj(31)
            if piece := member.decompress(rest):
                yield piece
            rest = member.unused_data
            if member.eof:
                member = None
    if member:
        raise ValueError("a gzip file ends within a member")


def parsed(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, dict[str, str], bytes]]:
    """(exact header bytes, headers by lower-case name, block) of each record of an archive's content; lengths alone say where a record ends."""
    more, held = iter(pieces), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(more, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("the archive ends within a header")
        header = bytes(held[: end + 4])
        lines = header[:-4].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should start: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        if not fill(stop + 4) or held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where its length says")
        yield header, fields, bytes(held[end + 4 : stop])
        del held[: stop + 4]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, record_type, refers_to, header, http_header, payload_digest, payload.

    Files may have a gzip member for all records or for each. payload is null for
    revisits. A stored payload whose digest is not the header's raises.
    """

    def number(urn: str | None) -> int | None:
        digits = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
        return int(digits) if digits else None

    names = ["page_id", "record_type", "refers_to", "header", "http_header", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                for header, fields, block in parsed(inflated(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    stored = fields["warc-type"] == "response"
                    if stored and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                    rows.append((number(fields["warc-record-id"]), fields["warc-type"], number(fields.get("warc-refers-to")), header, http + b"\r\n\r\n", digest, payload if stored else None))
                    held += len(block)
                    if held >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).where("length > 20").select("content")
    return files.mapInArrow(run, "page_id long, record_type string, refers_to long, header binary, http_header binary, payload_digest string, payload binary")


def payload_store(records: DataFrame) -> DataFrame:
    """payload_digest, payload: one row for each distinct stored payload that a revisit needs."""
    needed = records.where("record_type <> 'response'").select("payload_digest").distinct()
    return records.where("record_type = 'response'").join(needed, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.first("payload").alias("payload"))


def rebuilt(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, header, http_header and payload of every record: a response's own, a revisit's from the store by digest."""
    columns = ["page_id", "record_type", "refers_to", "header", "http_header", "payload"]
    again = records.where("record_type <> 'response'").drop("payload").join(payload_store(records), "payload_digest", "left")
    return records.where("record_type = 'response'").select(columns).unionByName(again.select(columns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests are those of the rebuilt records' payloads."""
    path = scratch.new_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = scratch.written(read_archive(spark, path), "warc-records")
    return rebuilt(records).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


QUERIES = {"op2_warc": op2_warc}

SQL = {
    "op2_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS original FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN f.original <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.original <> d.page_id THEN f.original END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest AND d.n >= 100
""",
}
