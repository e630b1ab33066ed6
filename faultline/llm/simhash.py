"""Document fingerprints by SimHash, with DataFrame functions only.

The terms of a text are its distinct words, letters and digits in lower case. A term's 240 hash bits vote for or against the
bits of the fingerprint, with the length of the term as their weight. Votes are counted four to a long, 64 running sums for
a text of a few thousand terms, and these are then added up bit by bit. Fingerprints within a Hamming radius are found by block tables: they are cut into more blocks than
bits may differ, so at least one block is equal, and each table has another block in front as its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.session import settle

#: A fingerprint is cut into pieces of so many bits; one piece is kept in a long.
PIECES, PIECE_BITS = 4, 60
BITS = PIECES * PIECE_BITS
#: Words longer than this weigh no more.
MAX_WEIGHT = 12
#: Four votes are counted in a long, for so many terms that none runs over; then they are added up one by one.
LANE = 16
FEW = ((1 << LANE) - 1) // MAX_WEIGHT
_SPLIT = r"[\x00-/:-@\[-`{-\x7F]+"
#: Rows that one bucket of neighbouring documents holds, and the most buckets; their borders are broadcast.
BUCKET_ROWS = 128
MAX_BUCKETS = 1 << 16
_SAMPLES = 8
#: Blocks of a fingerprint that block tables are keyed by.
BLOCK_BITS = 30
BLOCKS = BITS // BLOCK_BITS
RADIUS = BLOCKS - 1


def terms(text: str) -> str:
    """SQL: the distinct terms of ``text``; one may be empty and weighs nothing."""
    return f"array_distinct(split(lower({text}), r'{_SPLIT}'))"


def _ones(width: int, bits: int) -> int:
    """The lowest bit of every lane of ``width`` bits that starts below ``bits``."""
    return sum(1 << at for at in range(0, bits, width))


def _sums() -> list[Column]:
    """Over rows of ``weight, p0, p1, ...``: the total weight and the votes of a few terms, ``64 / LANE`` to a long."""
    sums = [F.expr("sum(weight)").alias("weight")]
    for k in range(PIECES):
        for i in range(LANE):
            ones = _ones(LANE, PIECE_BITS - i)
            sums.append(F.expr(f"sum((shiftrightunsigned(p{k}, {i}) & {ones}L) * weight)").alias(f"v{k}_{i}"))
    return sums


def _totals() -> list[Column]:
    """The sums of ``_sums`` added up for a whole text, each vote in a sum of its own."""
    mask = (1 << LANE) - 1
    return [F.sum("weight").alias("weight"), *[
        F.expr(f"sum(shiftrightunsigned(v{k}_{i % LANE}, {i // LANE * LANE}) & {mask}L)").alias(f"b{k}_{i}")
        for k in range(PIECES) for i in range(PIECE_BITS)]]


def _piece(k: int) -> str:
    """SQL: bits of piece ``k`` that have more than half of the weight."""
    return " | ".join(f"if(2 * b{k}_{i} > weight, {1 << i}L, 0L)" for i in range(PIECE_BITS))


def voted(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fingerprint``, an array of ``PIECES`` longs, of the terms of ``text`` in all rows that share the keys.

    Where ``rows`` are already partitioned by some of the keys, nothing is sent around. A text without terms has no votes:
    all bits are 0, as where votes are even.
    """
    each = rows.select(*keys, F.posexplode_outer(F.expr(terms(text))).alias("at", "term"))
    hashed = each.selectExpr(*keys, f"coalesce(at div {FEW}, 0) AS few", "sha2(coalesce(term, ''), 256) AS h",
                             f"cast(coalesce(least(length(term), {MAX_WEIGHT}), 0) as bigint) AS weight")
    digits = PIECE_BITS // 4
    pieces = [f"coalesce(cast(conv(substring(h, {digits * k + 1}, {digits}), 16, 10) as bigint), 0L) AS p{k}"
              for k in range(PIECES)]
    counted = hashed.selectExpr(*keys, "few", "weight", *pieces).groupBy(*keys, "few").agg(*_sums())
    whole = counted.groupBy(*keys).agg(*_totals())
    return whole.select(*keys, F.array(*[F.expr(_piece(k)) for k in range(PIECES)]).alias("fingerprint"))


def as_text(fingerprint: str | Column) -> Column:
    """Hexadecimal digits of a fingerprint."""
    col = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.lower(F.concat(*[F.lpad(F.hex(col[k]), PIECE_BITS // 4, "0") for k in range(PIECES)]))


def distance(a: str, b: str) -> Column:
    """Bits in which two fingerprints differ."""
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(PIECES)))


def likeness(a: str, b: str) -> Column:
    """Share of the bits that agree: 1 for equal fingerprints, about a half for texts that share no term."""
    return 1 - distance(a, b).cast("double") / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_id, copies, fingerprint`` of every distinct (doc_id, text); ``text_id`` is a 64-bit hash of the text.

    A null text counts as empty. Only ``doc_id`` and ``text`` are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_id"))
    found = voted(rows, ["doc_id", "text_id"], "text")
    copies = rows.groupBy("doc_id", "text_id").agg(F.count(F.lit(1)).alias("copies"))
    same = [found[c].eqNullSafe(copies[c]) for c in ("doc_id", "text_id")]
    return found.join(copies, same).select(found["doc_id"], found["text_id"], "copies", "fingerprint")


def _blocks(fingerprint: str) -> str:
    """SQL: (table, key) of every block of a fingerprint."""
    per = PIECE_BITS // BLOCK_BITS
    mask = (1 << BLOCK_BITS) - 1
    return "array(" + ", ".join(
        f"named_struct('t', {k * per + j}, 'key', shiftright({fingerprint}[{k}], {j * BLOCK_BITS}) & {mask}L)"
        for k in range(PIECES) for j in range(per)) + ")"


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``query, fingerprint, distance``: for every distinct fingerprint of ``queries``, all of ``prints`` within the radius.

    Both tables have a column ``fingerprint``; equal ones are taken together first, so copies cost nothing. At most
    ``RADIUS`` bits may differ, so that one block is equal; a pair is reported by the first table where it meets, none is
    lost and none comes twice. The fingerprints that share a block's value with a query are met one by one: one row per
    query and candidate, split by AQE where a value is frequent.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"the block tables find fingerprints within 0 to {RADIUS} bits")
    asked, known = (d.select("fingerprint").distinct() for d in (queries, prints))
    left = asked.select(F.col("fingerprint").alias("query"), F.expr(f"inline({_blocks('fingerprint')})"))
    right = known.select("fingerprint", F.expr(f"inline({_blocks('fingerprint')})"))
    met = left.join(right, ["t", "key"])
    first = F.expr(f"filter(arrays_zip({_blocks('query')}, {_blocks('fingerprint')}), x -> x['0'].key = x['1'].key)[0]['0'].t")
    return met.withColumn("distance", distance("query", "fingerprint")).filter(F.col("distance") <= radius).filter(
        first == F.col("t")).select("query", "fingerprint", "distance")


def _borders(keys: DataFrame, rows: int) -> DataFrame:
    """One row ``borders``: sorted keys, the largest one of all among them, that cut the rows into buckets of like size.

    They decide which rows are looked at together, not what is found, so a sample of the keys does.
    """
    wanted = max(1, min(MAX_BUCKETS, rows // BUCKET_ROWS))
    last = keys.agg(F.max("key").alias("last"))
    if wanted == 1:
        return last.select(F.array("last").alias("borders"))
    some = keys.sample(min(1.0, _SAMPLES * wanted / rows), seed=1).agg(F.sort_array(F.collect_list("key")).alias("some"))
    step = f"greatest(1, size(some) div {wanted})"
    cut = F.expr(f"array_sort(array_union(transform(sequence(1, size(some) div {step}), i -> some[i * {step} - 1]), array(last)))")
    return some.crossJoin(last).select(F.when(F.size("some") > 0, cut).otherwise(F.array("last")).alias("borders"))  # one row each


def _in_order(docs: DataFrame) -> DataFrame:
    """``bucket, ord, guest, doc_id, copies, text, next_text`` of every distinct (doc_id, text), by descending doc_id.

    Buckets hold neighbouring documents. The first of a bucket is also a guest at the end of the one before it, so every row
    sees the next; the first of all is a guest of the last bucket. The borders, at most ``MAX_BUCKETS`` keys, are sent to
    all tasks, and each row finds its bucket by halving steps over them. Texts are sent around once.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("text_id"))
    keys = settle(rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("copies")))
    seen = keys.agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).first()
    if (seen["most"] or 1) > 1:
        rows = rows.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    borders = _borders(keys, seen["n"]).collect()
    borders = rows.sparkSession.createDataFrame(borders, "borders array<struct<doc_id:%s,text_id:bigint>>" % (
        rows.schema["doc_id"].dataType.simpleString()))
    steps = ", ".join(str(1 << i) for i in reversed(range(MAX_BUCKETS.bit_length())))
    below = (f"aggregate(array({steps}), 0, (p, s) -> if(p + s <= size(borders) AND get(borders, p + s - 1) < key, p + s, p))")
    placed = rows.withColumn("key", key).crossJoin(F.broadcast(borders)).withColumn("p", F.expr(below))  # one row of borders
    own = "named_struct('bucket', p, 'guest', 0)"
    guest = "named_struct('bucket', (p + 1) % size(borders), 'guest', 1)"
    placed = placed.withColumn("places", F.expr(f"if(get(borders, p) <=> key, array({own}, {guest}), array({own}))"))
    dealt = placed.select("key", "copies", "text", F.inline("places")).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(
        "guest", F.col("key.doc_id").desc_nulls_last(), F.col("key.text_id").desc(), F.col("text").desc())
    return dealt.select("bucket", "guest", F.col("key.doc_id").alias("doc_id"), "copies", "text",
                        F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("ord"))


def _edited(own: str, other: str) -> Column:
    """The text ``own``, the last half of its code points replaced by the first as many of ``other``."""
    return F.expr(f"concat(left({own}, length({own}) - length({own}) div 2), left({other}, length({own}) div 2))")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text of a document ends with the beginning of the next one, by descending ``doc_id``: its last half of code
    points is replaced by as many first ones (or all) of the next. The last document is followed by the first; a single one
    by itself. Null ids come last; rows that share an id are ordered by a hash of their texts. Of equal rows each is followed
    by another copy, but for the last one, which the next different row follows: such rows are counted first and looked at
    once. A null text counts as empty; texts of any length work; only ``doc_id`` and ``text`` are read; an empty table stays
    empty.
    """
    rows = _in_order(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", _edited("text", "next_text"))
    own, edit, again = ("named_struct('kind', %d, 't', %s)" % x for x in (
        (0, "text"), (1, "edited"), (2, "concat(left(text, length(text) - length(text) div 2), left(text, length(text) div 2))")))
    kinds = F.expr(f"CASE WHEN guest = 1 THEN array({own}) WHEN copies = 1 THEN array({own}, {edit}) "
                   f"ELSE array({own}, {edit}, {again}) END")
    keys = ["bucket", "ord", "guest", "doc_id", "copies", "n_chars", "kind", "sha256"]
    texts = rows.select(*keys[:6], F.inline(kinds)).withColumn("sha256", F.when(F.col("kind") > 0, F.sha2("t", 256)))
    prints = voted(texts, keys, "t")

    def of(kind: int, column: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    wide = prints.groupBy(*keys[:6]).agg(
        of(0, "fingerprint").alias("own"), of(1, "fingerprint").alias("edit"), of(1, "sha256").alias("edit_sha256"),
        of(2, "fingerprint").alias("again"), of(2, "sha256").alias("again_sha256"))
    wide = wide.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("ord"))).filter("guest = 0")
    last = "named_struct('e', edit, 's', edit_sha256, 'a', after, 'n', 1L)"
    others = "named_struct('e', again, 's', again_sha256, 'a', own, 'n', copies - 1)"
    rows = wide.select("doc_id", "n_chars", "own", F.expr(f"inline(if(copies = 1, array({last}), array({last}, {others})))"))
    many = 1 << 16
    repeats = rows.withColumn("full", F.explode(F.expr(f"sequence(0L, (n - 1) div {many})"))).withColumn(
        "one", F.explode(F.expr(f"sequence(1L, least({many}L, n - full * {many}L))")))
    return repeats.select("doc_id", "n_chars", F.col("s").alias("edited_sha256"), as_text("own").alias("fingerprint"),
                          as_text("e").alias("edited_fingerprint"), likeness("own", "e").alias("near_edited"),
                          likeness("own", "a").alias("near_next"))
