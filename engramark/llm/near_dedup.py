"""Near-duplicate groups by MinHash.

Many universal hash minima of every document's shingle set, banding, a check of
signatures, a confirmation on the full sets, and connected components.

Work is done on one representative of each distinct set. In every bucket the
members are first compared with its smallest one (a star, not all pairs), and the
confirmed links are joined into components. Members of one bucket that are still
in different components, and whose signatures agree, form families: every member
of such a pair is in one, not one member for each component, as a pair that agrees
need not be a link while another of the same components is. Within a family all
such pairs are compared, so that no link which banding sees is lost: members of
one component need no further comparison, as it could only confirm what is known.

With 32 bands of 4 minima a pair of similarity 0.85 shares no band once in 10**10
pairs, one of 0.8 once in 2 * 10**7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramark.llm import bytetext, scratch
from engramark.llm.components import components

BANDS, ROWS = 32, 4
#: Pairs whose signatures agree in a smaller part than the threshold less this are not linked: six standard deviations of 128 minima.
SIGNATURE_SLACK = 0.2
#: Partners of a centre, members of a bucket, and shingles of a family that one step takes; larger ones are cut into blocks.
STAR_BLOCK = 64
BLOCK = 2048
FAMILY_SHINGLES = 1 << 20


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    draw = bytetext.mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (draw[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (draw[1::2] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words than ``size`` is one shingle, one without words none."""
    hashes, _, _, pointer = bytetext.words(data, offs)
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + len(rolled)]
    rolled = bytetext.mix(rolled)
    sets = []
    for a, b in zip(pointer[:-1], pointer[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(b - a)
            for h in hashes[a:b]:
                whole = whole * np.uint64(0xFF51AFD7ED558CCD) + h
            sets.append(bytetext.mix(np.array([whole])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of (a x + b) mod 2**32, x being the shingles' upper halves."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * a + b).min(0), out=least)
    return least


def _set_key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key and signature (both null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        with np.errstate(over="ignore"):
            for rows, data, offs in bytetext.pieces(batches):
                sets = shingle_sets(data, offs, size)
                keys = [_set_key(s) if len(s) else None for s in sets]
                minima = [signature(s, a, b).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(minima, pa.binary())], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def band_rows(reps: DataFrame) -> DataFrame:
    """(bucket, rep): a row for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, _ = bytetext.column_bytes(batch.column(1))
                minima = data.view(np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for k in range(ROWS):
                    key = bytetext.mix(key ^ minima[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["bucket", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "bucket long, rep long")


def agreeing(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose signatures and set sizes leave the similarity possible."""
    one = reps.select(F.col("rep").alias("u"), F.col("signature").alias("su"), F.col("n_shingles").alias("nu"))
    two = reps.select(F.col("rep").alias("v"), F.col("signature").alias("sv"), F.col("n_shingles").alias("nv"))
    least = (threshold - SIGNATURE_SLACK) * BANDS * ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (bytetext.column_bytes(batch.column(k))[0].view(np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            on = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], ["u", "v"])

    sized = pairs.join(one, "u").join(two, "v").where(F.least("nu", "nv") >= threshold * F.greatest("nu", "nv"))
    return sized.select("u", "v", "su", "sv").mapInArrow(run, "u long, v long")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """The pairs (u, v) with whole * |intersection| >= part * |union| of the full sets.

    The partners of a centre u come to it in blocks of STAR_BLOCK, each with one copy of
    the centre's text, and are compared one after another as they stream by.
    """
    blocks = pairs.join(pairs.groupBy("u").agg(F.count("*").alias("n")), "u")
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / STAR_BLOCK).cast("long")))
    wanted = blocks.select("u", "block", F.col("v").alias("rep"), F.lit(1).alias("role"))
    wanted = wanted.union(blocks.select("u", "block", F.col("u").alias("rep"), F.lit(0).alias("role")).distinct())
    parts = scratch.shuffle_partitions(pairs.sparkSession)
    rows = wanted.join(texts, "rep").repartition(parts, "u", "block").sortWithinPartitions("u", "block", "role").select("u", "rep", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres: list[np.ndarray] = []  # more than one where a doc_id has several texts
        begun = False
        with np.errstate(over="ignore"):
            for rows, data, offs in bytetext.pieces(batches):
                sets = shingle_sets(data, offs, size)
                links: list[list[int]] = [[], []]
                for u, v, role, shingles in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), sets, strict=True):
                    if role == 0:
                        centres = [*centres, shingles] if begun else [shingles]
                        begun = True
                        continue
                    begun = False
                    for centre in centres:
                        common = len(np.intersect1d(centre, shingles, assume_unique=True))
                        if whole * common >= part * (len(centre) + len(shingles) - common):
                            links[0].append(u), links[1].append(v)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def _blocks(members: DataFrame, key: str, weight: F.Column, most: int) -> DataFrame:
    """Members of each ``key`` cut into blocks of about ``most`` total weight, once for each pair (low, high) of blocks; mine is a member's own."""
    counted = members.join(members.groupBy(key).agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks")), key)
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cut = counted.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other")).drop("blocks", "other")


def _near(i: int, root: np.ndarray, on: np.ndarray, size: np.ndarray, sigs: np.ndarray, threshold: float) -> np.ndarray:
    """Members marked in ``on``, outside the group of i, whose set sizes and signatures leave the similarity possible."""
    near = np.flatnonzero(on & (root != root[i]) & (np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])))
    return near[(sigs[near] == sigs[i]).sum(1) >= (threshold - SIGNATURE_SLACK) * BANDS * ROWS]


def _links(u: list, v: list) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def crossing(members: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that join members of one bucket which are in different components and may be similar: a forest for each pair of blocks, not all pairs.

    The forest is one of members, and components are not merged in it: its trees hold
    both members of each such pair. members has bucket, rep, component, n_shingles and signature.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, root, size, mine = (table.column(c).to_numpy().copy() for c in ("rep", "component", "n_shingles", "mine"))
        sigs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
        _, tree = np.unique(rep, return_inverse=True)
        on, u, v = mine == key[2].as_py(), [], []
        for i in np.flatnonzero(mine == key[1].as_py()):
            near = _near(i, root, on & (tree != tree[i]), size, sigs, threshold)
            for j in near[np.unique(tree[near], return_index=True)[1]]:
                u.append(rep[i]), v.append(rep[j])
                tree[tree == tree[j]] = tree[i]
        return _links(u, v)

    cut = _blocks(members, "bucket", F.lit(1), BLOCK).select("bucket", "low", "high", "mine", "rep", "component", "n_shingles", "signature")
    return cut.groupBy("bucket", "low", "high").applyInArrow(run, "u long, v long").distinct()


def family_links(members: DataFrame, size: int, part: int, whole: int) -> DataFrame:
    """Links (u, v), confirmed on full sets, between the different components of each family.

    members has family, rep, component, n_shingles, signature and text. All pairs
    of a family that may be similar are compared where they are, and those that
    links already join are passed over; only a forest of links comes out.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, root, n, mine = (table.column(c).to_numpy().copy() for c in ("rep", "component", "n_shingles", "mine"))
        sigs = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(rep), -1)
        _, root = np.unique(root, return_inverse=True)
        with np.errstate(over="ignore"):
            sets = [s for _, data, offs in bytetext.pieces(iter(table.to_batches())) for s in shingle_sets(data, offs, size)]
        pointer = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        distinct, names = np.unique(np.concatenate(sets), return_inverse=True)
        has, on, u, v = np.zeros(len(distinct), bool), mine == key[2].as_py(), [], []
        for i in np.flatnonzero(mine == key[1].as_py()):
            near = _near(i, root, on, n, sigs, part / whole)
            if not len(near):
                continue
            own = names[pointer[i] : pointer[i + 1]]
            has[own] = True
            for j in near:
                if root[j] != root[i]:
                    common = np.count_nonzero(has[names[pointer[j] : pointer[j + 1]]])
                    if whole * common >= part * (len(own) + pointer[j + 1] - pointer[j] - common):
                        u.append(rep[i]), v.append(rep[j])
                        root[root == root[j]] = root[i]
            has[own] = False
        return _links(u, v)

    cut = _blocks(members, "family", F.col("n_shingles"), FAMILY_SHINGLES).select("family", "low", "high", "mine", "rep", "component", "n_shingles", "signature", "text")
    return cut.groupBy("family", "low", "high").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are lower-cased (A-Z) runs without white space; a document's set is its
    distinct shingles of ``size`` words, or its whole sequence as one where it has
    fewer. Documents with whole * |intersection| >= part * |union| are linked, and
    component_id is the smallest doc_id reachable. Null, empty and blank texts have
    an empty set and are linked with nothing. Rows that repeat a doc_id are one
    document with several sets. A row with a null doc_id is linked with nothing,
    has a null component_id and is kept. An empty table gives no rows; other
    columns are not read.
    """
    threshold = part / whole
    sigs = scratch.written(signatures(docs, size), "signatures")
    filled = sigs.where("set_key is not null and doc_id is not null")
    classes = scratch.written(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi")
    reps = scratch.written(reps.dropDuplicates(["set_key", "doc_id"]).select(F.col("doc_id").alias("rep"), "n_shingles", "set_key", "signature"), "representatives")
    bands = scratch.written(band_rows(reps), "bands")
    buckets = bands.groupBy("bucket").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most")
    shared = scratch.written(bands.join(buckets.select("bucket", "least"), "bucket"), "buckets")
    involved = shared.select("rep").distinct()

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = scratch.written(texts.join(involved, "rep", "left_semi").dropDuplicates(), "texts")

    star = shared.where("rep <> least").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    tried = scratch.written(agreeing(star, reps, threshold), "star-pairs")
    links = scratch.written(confirmed(tried, texts, size, part, whole), "star-links")
    first = components(links)

    placed = shared.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("bucket")
    members = scratch.written(placed.join(open_buckets, "bucket", "left_semi").join(reps.select("rep", "n_shingles", "signature"), "rep"), "open-buckets")
    families = components(crossing(members, threshold)).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    related = families.join(members.dropDuplicates(["rep", "signature"]).drop("bucket"), "rep").join(texts, "rep")
    more = family_links(related, size, part, whole)

    # A document of several sets links their classes.
    own = filled.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = filled.join(own, "doc_id", "left_semi").join(classes, "set_key").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    final = components(links.union(more).union(several))

    labelled = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("doc_id", "n_shingles", "set_key").join(labelled, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, part=85, whole=100)


QUERIES = {"op9_near_dedup": op9_near_dedup}

SQL = {
    "op9_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS g
  FROM w WHERE len(ws) >= 3
  UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) m USING (doc_id)
""",
}
