"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text's words are cut into paragraphs by content: at level k one ends after each
word whose digest is a multiple of 2**k, so that where paragraphs end depends on
nothing but the words beside. A fingerprint holds a sketch for every level with at
most MOST distinct paragraphs, up to the level at which the whole text is one. Each
distinct digest is entered in one cell of each of three tables: a count, and
exclusive-ors of digests and of their checks; a sketch is doubled until all its
digests can be peeled out of it.

Two fingerprints are compared without their texts, at the finest level that both
have: the larger sketch is folded to the size of the smaller, cells are subtracted,
and peeling those that hold a single digest recovers the digests that differ. Where
that fails there are too many for the smaller sketch: then each is peeled in its own
size, which is large enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramark.llm import scratch

TABLES = 3
#: Distinct paragraphs of a level that is sketched, and the level at which the whole of any text is one.
MOST, TOP = 16, 40
#: Times that a sketch is doubled if it can't be peeled; two digests collide in all tables of 2**13 cells once in 2**39.
DOUBLINGS = 8
#: Rounds of peeling: a round takes at least one digest, and a sketch that can be peeled needs few.
ROUNDS = 40
#: Characters from which on a word goes by its characters, each with the two before it.
LONG_WORD = 64
#: Bytes of texts in a range of doc_ids.
RANGE_BYTES = 32 << 20


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words(text: str) -> str:
    """Digests of a text's words, in order."""
    letters = let("_c", "split(_w, '')", "transform(_c, (_y, _i) -> xxhash64(_y, get(_c, _i - 1), get(_c, _i - 2)))")
    split = f"array_remove(split({text}, '\\\\s+'), '')"
    return let("_s", split, f"if({text} rlike '\\\\S{{{LONG_WORD + 1}}}', flatten(transform(_s, _w -> if(char_length(_w) > {LONG_WORD}, {letters}, array(xxhash64(_w))))), transform(_s, _w -> xxhash64(_w)))")


def _paragraphs(digests: str, ends: str) -> str:
    """Distinct digests of the runs of words that end at the positions ``ends`` (from 1), and of what follows the last."""
    return f"array_distinct(transform({ends}, (_e, _i) -> xxhash64(slice({digests}, if(_i = 0, 1, {ends}[_i - 1] + 1), if(_i = 0, _e, _e - {ends}[_i - 1])))))"


def levels(digests: str) -> str:
    """(level, paragraphs) of a text's word digests: the sketched levels in ascending order.

    Levels are tried from the one at which as many words as there are distinct ones
    give about MOST paragraphs, up to the first with a single paragraph. A text
    without words has level 0 without paragraphs.
    """
    first = f"cast(greatest(0, floor(log2(greatest(1, size(array_distinct({digests})))) - log2({MOST}))) as int)"
    cuts = f"filter(sequence(1, size({digests})), _p -> _p = size({digests}) or ({digests}[_p - 1] & (shiftleft(1L, _f) - 1L)) = 0L)"
    # A level's ends are among those of the level below.
    higher = f"filter(_l.ends, _p -> _p = size({digests}) or ({digests}[_p - 1] & (shiftleft(1L, _l.level + 1) - 1L)) = 0L)"
    held = let("_k", _paragraphs(digests, "_l.ends"), f"if(size(_k) <= {MOST}, concat(_l.done, array(named_struct('level', _l.level, 'paragraphs', _k))), _l.done)")
    step = f"if(_l.over, _l, named_struct('level', _l.level + 1, 'ends', {higher}, 'done', {held}, 'over', size(_l.ends) <= 1))"
    start = let("_f", first, f"named_struct('level', _f, 'ends', {cuts}, 'done', cast(array() as array<struct<level: int, paragraphs: array<bigint>>>), 'over', false)")
    found = f"aggregate(sequence(0, {TOP}), {start}, (_l, _i) -> {step}, _l -> _l.done)"
    return f"if(size({digests}) = 0, array(named_struct('level', 0, 'paragraphs', cast(array() as array<bigint>))), {found})"


def _place(digest: str, table: int, size: str) -> str:
    return f"cast(shiftrightunsigned({digest}, {16 * table}) & cast({size} - 1 as bigint) as int)"


def cells(digests: str, size: str) -> str:
    """A sketch: the cells (n, k, h) of three tables of ``size`` cells, a power of two: count, and exclusive-ors of digests and of their checks."""

    def table(t: int) -> str:
        held = f"filter({digests}, _k -> {_place('_k', t, size)} = _c)"
        full = "named_struct('n', size(_h), 'k', aggregate(_h, 0L, (_a, _k) -> _a ^ _k), 'h', aggregate(_h, 0, (_a, _k) -> _a ^ hash(_k)))"
        return f"transform(sequence(0, {size} - 1), _c -> {let('_h', held, f'if(size(_h) = 0, {EMPTY}, {full})')})"

    return f"concat({', '.join(table(t) for t in range(TABLES))})"


EMPTY = "named_struct('n', 0, 'k', 0L, 'h', 0)"


def _sums(entries: str, digest: str, check: str, count: str) -> str:
    """A cell that adds up ``entries`` (named _p)."""
    return f"named_struct('n', aggregate({entries}, 0, (_a, _p) -> _a + {count}), 'k', aggregate({entries}, 0L, (_a, _p) -> _a ^ {digest}), 'h', aggregate({entries}, 0, (_a, _p) -> _a ^ {check}))"


def peeled(difference: str) -> str:
    """Digests (k, n) that peeling recovers from cells, or null if some are left; n is 1 for those of the first sketch and -1 for those of the second."""
    single = "filter(_s.cells, _c -> abs(_c.n) = 1 and _c.h = hash(_c.k))"
    places = ", ".join(f"'c{t}', {_place('_c.k', t, '_m')}" for t in range(TABLES))
    found = f"array_distinct(transform({single}, _c -> named_struct('k', _c.k, 'n', _c.n, {places})))"
    taken = let("_o", _sums("_q", "_p.k", "hash(_p.k)", "_p.n"), "named_struct('n', _c.n - _o.n, 'k', _c.k ^ _o.k, 'h', _c.h ^ _o.h)")
    # Nothing is to be taken from a cell of zeros.
    left = (f"transform(slice(_s.cells, {t} * _m + 1, _m), (_c, _j) -> if(_c.n = 0 and _c.k = 0L, _c, {let('_q', f'filter(_f, _p -> _p.c{t} = _j)', f'if(size(_q) = 0, _c, {taken})')}))" for t in range(TABLES))
    taking = f"named_struct('cells', concat({', '.join(left)}), 'found', concat(_s.found, transform(_f, _p -> named_struct('k', _p.k, 'n', _p.n))), 'over', false)"
    step = let("_f", found, f"if(size(_f) = 0, named_struct('cells', _s.cells, 'found', _s.found, 'over', true), {taking})")
    start = "named_struct('cells', _d, 'found', cast(array() as array<struct<k: bigint, n: int>>), 'over', false)"
    run = f"aggregate(sequence(1, {ROUNDS}), {start}, (_s, _i) -> if(_s.over, _s, {step}), _s -> if(exists(_s.cells, _c -> _c.n <> 0 or _c.k <> 0L or _c.h <> 0), null, _s.found))"
    return let("_d", difference, let("_m", f"cast(size(_d) div {TABLES} as int)", run))


def fingerprint(text: str) -> Column:
    """The fingerprint of a text column: (level, cells) of each sketched level. Equal texts have equal ones; a null text has a null one."""
    size = "cast(power(2, ceil(log2(greatest(4, size(_x.paragraphs)))) + 1) as int)"
    larger = cells("_x.paragraphs", f"cast(size(_g.cells) div {TABLES} * 2 as int)")
    # A table with a cell for each digest needs no peeling.
    plain = " or ".join(f"not exists(slice(_g.cells, cast({t} * size(_g.cells) div {TABLES} + 1 as int), cast(size(_g.cells) div {TABLES} as int)), _c -> _c.n > 1)" for t in range(TABLES))
    grown = f"if({plain} or {peeled('_g.cells')} is not null, named_struct('cells', _g.cells, 'over', true), named_struct('cells', {larger}, 'over', false))"
    fitting = f"aggregate(sequence(1, {DOUBLINGS}), named_struct('cells', {let('_z', size, cells('_x.paragraphs', '_z'))}, 'over', false), (_g, _i) -> if(_g.over, _g, {grown}), _g -> _g.cells)"
    return F.expr(let("_t", words(text), f"transform({levels('_t')}, _x -> named_struct('level', _x.level, 'cells', {fitting}))"))


def _folded(sketch: str, size: str) -> str:
    """A sketch with ``size`` cells in each table, at most as many as it has: cells that fall together are added."""
    here = f"transform(sequence(0, cast(size({sketch}) div {TABLES} div {size} as int) - 1), _r -> {sketch}[cast(_t * (size({sketch}) div {TABLES}) + _r * {size} + _c as int)])"
    table = f"transform(sequence(0, {size} - 1), _c -> {let('_q', here, _sums('_q', '_p.k', '_p.h', '_p.n'))})"
    return f"if(size({sketch}) = {TABLES} * {size}, {sketch}, flatten(transform(sequence(0, {TABLES - 1}), _t -> {table})))"


def likeness(one: str, two: str) -> Column:
    """(level, difference, likeness) of two fingerprint columns: the finest common level, the digests (k, n) that differ there, and common paragraphs over all (1 for two texts without any)."""

    def has(prints: str) -> str:
        return f"(exists({prints}, _x -> _x.level = _g) or _g > element_at({prints}, -1).level)"

    def at(prints: str) -> str:
        # The highest level stands for all above, where the text still is one paragraph.
        return f"element_at(filter({prints}, _x -> _x.level <= _level), -1).cells"

    def count(sketch: str) -> str:
        return f"aggregate(slice({sketch}, 1, cast(size({sketch}) div {TABLES} as int)), 0, (_a, _x) -> _a + _x.n)"

    level = f"array_min(filter(concat(transform({one}, _x -> _x.level), transform({two}, _x -> _x.level)), _g -> {has(one)} and {has(two)}))"
    subtracted = f"zip_with({_folded('_one', '_z')}, {_folded('_two', '_z')}, (_x, _y) -> named_struct('n', _x.n - _y.n, 'k', _x.k ^ _y.k, 'h', _x.h ^ _y.h))"
    only = "filter({0}, _x -> not exists({1}, _y -> _y.k = _x.k))"
    alone = let("_ones", peeled("_one"), let("_twos", peeled("_two"), f"concat({only.format('_ones', '_twos')}, transform({only.format('_twos', '_ones')}, _x -> named_struct('k', _x.k, 'n', -1)))"))
    found = let("_z", f"cast(least(size(_one), size(_two)) div {TABLES} as int)", f"coalesce({peeled(subtracted)}, {alone})")
    near = let("_total", f"{count('_one')} + {count('_two')}", "if(_total = 0, 1D, cast(_total - size(_found) as double) / (_total + size(_found)))")
    result = let("_found", found, f"named_struct('level', _level, 'difference', _found, 'likeness', {near})")
    return F.expr(let("_level", level, let("_one", at(one), let("_two", at(two), result))))


def printed(prints: str) -> Column:
    """A fingerprint as a string, ``level:cells`` for each level, apart by ``;``: count, digest and check of each cell in hexadecimal, apart by commas; an empty cell is empty."""
    cell = "if(_c.n = 0, '', concat(hex(_c.n), '.', hex(_c.k), '.', substring(hex(cast(_c.h as bigint)), -8)))"
    return F.expr(f"array_join(transform({prints}, _x -> concat(_x.level, ':', array_join(transform(_x.cells, _c -> {cell}), ','))), ';')")


def parsed(shown: str) -> Column:
    """The fingerprint that a string shows."""
    number = "cast(conv({0}, 16, 10) as decimal(20))"
    digest = let("_k", number.format("_p[1]"), "cast(if(_k >= 9223372036854775808BD, _k - 18446744073709551616BD, _k) as bigint)")
    check = let("_h", "cast(conv(_p[2], 16, 10) as bigint)", "cast(if(_h >= 2147483648L, _h - 4294967296L, _h) as int)")
    cell = let("_p", "split(_c, '[.]')", f"if(_c = '', {EMPTY}, named_struct('n', cast(conv(_p[0], 16, 10) as int), 'k', {digest}, 'h', {check}))")
    sketch = let("_y", "split(_x, ':')", f"named_struct('level', cast(_y[0] as int), 'cells', transform(split(_y[1], ','), _c -> {cell}))")
    return F.expr(f"transform(split({shown}, ';'), _x -> {sketch})")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text and next_fingerprint, of the next document in descending order of doc_id; after the last comes the first.

    Equal doc_ids follow each other by their texts' hashes; null doc_ids come last; a
    null text is empty; one document is next to itself; an empty table gives no rows.
    Documents are dealt by ranges of doc_id of about RANGE_BYTES, and each range also
    gets a copy of the first document of the next one, so that no step orders all.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("k", F.coalesce("doc_id", F.lit(-(1 << 63))))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(scratch.shuffle_partitions(spark), -(-size // RANGE_BYTES))
    found = texts.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    cuts = sorted(set(found))
    # The range of k is the number of cuts below it, found by halving.
    dealt = texts.withColumn("p", _cuts_below("k", cuts))
    firsts = sorted(tuple(r) for r in dealt.groupBy("p").agg(F.max("k")).collect())
    if not firsts:
        return texts.select("doc_id", "text", fingerprint("text").alias("fingerprint"), F.col("text").alias("next_text")).withColumn("next_fingerprint", F.col("fingerprint"))
    # The next range of p is the one below it; below the lowest comes the highest.
    target = {first: firsts[(n + 1) % len(firsts)][0] for n, (_, first) in enumerate(firsts)}
    ids = F.create_map(*(F.lit(x) for pair in target.items() for x in pair))
    edge = texts.where(F.col("k").isin([*target])).withColumn("to", ids[F.col("k")])
    edge = edge.groupBy("to").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("k"), F.col("to").alias("p"), F.lit(1).alias("copy"))
    both = dealt.select("doc_id", "text", "k", "p", F.lit(0).alias("copy")).unionByName(edge).repartitionById(parts, "p")
    order = Window.partitionBy("p").orderBy("copy", F.desc("k"), F.xxhash64("text"))
    both = both.withColumn("fingerprint", fingerprint("text")).withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order))
    return both.where("copy = 0").select("doc_id", "text", "fingerprint", F.col("next.text").alias("next_text"), F.col("next.fingerprint").alias("next_fingerprint"))


def _cuts_below(column: str, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are below a column, by a binary search of comparisons."""
    if not cuts:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) > F.lit(cuts[middle]), search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))


def compared(pairs: DataFrame) -> DataFrame:
    """Adds edited_fingerprint, and edited_difference, near_edited, next_difference and near_next from the fingerprints alone.

    pairs has fingerprint, edited (a text) and next_fingerprint; all its columns stay.
    """
    x = pairs.withColumn("edited_fingerprint", fingerprint("edited"))
    x = x.withColumn("_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("_next", likeness("fingerprint", "next_fingerprint"))
    return x.select(*pairs.columns, "edited_fingerprint", F.col("_edited.difference").alias("edited_difference"), F.col("_edited.likeness").alias("near_edited"), F.col("_next.difference").alias("next_difference"), F.col("_next.likeness").alias("near_next"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's. A null text is empty."""
    docs = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    half = F.expr("cast(char_length(text) div 2 as int)")
    edited = F.concat(F.expr("left(text, cast(char_length(text) - char_length(text) div 2 as int))"), F.left("next_text", half))
    out = compared(docs.withColumn("edited", edited))
    prints = (printed(c).alias(c) for c in ("fingerprint", "edited_fingerprint"))
    return out.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *prints, "near_edited", "near_next")


QUERIES = {"op10_fingerprint": op10_fingerprint}
SQL: dict[str, str] = {}
