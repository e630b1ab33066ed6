"""Self-join of documents on the Jaccard similarity of their word n-grams, by T-occurrence search.

A set of n shingles that reaches the threshold with another shares at least ``need(n)`` shingles with it, so in any fixed
order of shingles both have k in common among their first ``n - need(n) + k``. The order puts the most frequent shingles
last (the long inverted lists are left out first, as in DivideSkip); it decides costs only, never results.

1. Count frequent shingles over all documents (each task reports what it meets repeatedly; the ``FREQUENT`` highest sums
   are kept, a fixed bound).
2. Per document: class (digest of the set; equal sets are one class), parity sketch, leading shingles.
3. Inverted lists of the leading shingles, those with two classes or more; a class that is in too few of them for any link
   leaves them. Within a list, pairs that neither the sizes nor the sketches rule out are joined into groups; a list hands
   on one edge per class, never its pairs. Long lists are cut into blocks; classes that do not come together within their
   first blocks, in this list or another, meet in pairs of blocks.
4. Connected components of these edges hold all links. In each, an inverted index over the full sets answers, for every
   class, which others share enough: short lists are merged and counted, long ones probed by binary search. Classes
   already connected are not asked for again. Large components are cut into blocks, and every two blocks meet.
5. Connected components of the links found, and the smallest id in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.llm.common import SPACE_CLASS, WordNames, mix, pair_name, slices, split_words
from faultline.llm.components import components
from faultline.session import fresh_dir

WORDS = 5
PERCENT = 80
#: Shingles that are ordered by frequency; a fixed bound on what is broadcast.
FREQUENT = 1 << 17
#: Shingles that a task counts at a time.
COUNTED = 1 << 22
#: Classes of a list, and shingles of a component, that one task looks at against as many.
LIST_BLOCK = 2048
INDEX_BLOCK = 1 << 20
#: Words of 64 bits in the parity sketches of the smallest and the largest sets; about a bit per shingle in between.
SKETCH_WORDS, MOST_SKETCH_WORDS = 8, 256
#: Rows of the lists in a share, to each of which a class sends its sketch once.
LIST_SHARE = 1 << 18
#: Leading shingles beyond the first that are asked for, in percent of the set.
LEAD_PERCENT = 5
#: Bits of the filter of documents whose sets are wanted; a fixed bound on what is broadcast.
FILTER_BITS = 1 << 22
#: Stands for a null id.
NO_ID = -(1 << 63)

_U = np.uint64


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles without which a set of ``n`` links with nothing."""
    return -(-n * percent // 100)


def shingle_sets(texts: pa.Array, known: WordNames, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text, one text after the other; how many each has)."""
    lower = pc.ascii_lower(pc.fill_null(texts, b"").view(pa.string())).view(pa.binary())
    codes, distinct, counts = split_words(lower)
    names = known.of(distinct)[codes] if len(codes) else np.zeros(0, _U)
    width = np.minimum(counts, words)
    n = np.where(counts > 0, counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(text)) + np.repeat(np.cumsum(counts) - counts - (np.cumsum(n) - n), n)
    out, left = names[at], width[text] - 1
    for j in range(1, words):
        more = left >= j
        out[more] = pair_name(out[more], names[at[more] + j], 77)
    order = np.lexsort((out, text))
    out = out[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.bincount(text[keep], minlength=len(counts))


def in_common(n: np.ndarray) -> np.ndarray:
    """Leading shingles, beyond the first, that sets of ``n`` or more are sure to share with a set they link with."""
    return n * LEAD_PERCENT // 100


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def sketch_words(n: np.ndarray) -> np.ndarray:
    """Words of the sketch of sets of ``n``: a power of two."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).astype(np.int64).clip(0), SKETCH_WORDS, MOST_SKETCH_WORDS)


def sketches(shingles: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Parities of the shingles by some bits of their names: sets that differ in k shingles differ in at most k bits.

    Sketches of unequal length are compared after folding the longer one, which loses differences but makes none.
    """
    out: list[bytes] = []
    all_words, ends = sketch_words(counts), np.cumsum(counts)
    cuts = np.flatnonzero(np.diff(np.cumsum(all_words) >> 14, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(counts)]):  # about a million bits at a time
        words, n = all_words[a:b], counts[a:b]
        starts = np.cumsum(words) - words
        text = np.repeat(np.arange(b - a), n)
        names = mix(shingles[ends[a] - counts[a]:ends[b - 1]] + _U(3))
        bit = (names & (words[text] * 64 - 1).astype(_U)).astype(np.int64)
        odd = np.bincount(starts[text] * 64 + bit, minlength=int(words.sum()) * 64) & 1
        raw = np.packbits(odd.astype(np.uint8), bitorder="little")
        out += [raw[8 * x:8 * (x + w)].tobytes() for x, w in zip(starts.tolist(), words.tolist())]
    return out


def digests(shingles: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit name per set."""
    return mix(_sums(mix(shingles + _U(11)), n) * _U(0x9E3779B97F4A7C15) + n.astype(_U)).view(np.int64)


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(the shingles met most often, sorted; how often), ``FREQUENT`` at most; ``docs`` has ``text`` as binary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordNames(), [], 0

        def report() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["g", "n"])

        for batch in slices(batches, "text"):
            held.append(shingle_sets(batch.column("text"), known, words)[0])
            size += len(held[-1])
            if size >= COUNTED:
                yield report()
                held, size = [], 0
        if held:
            yield report()

    rows = (docs.select("text").mapInArrow(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), "g").limit(FREQUENT).toArrow())
    values = rows["g"].to_numpy().view(_U)
    order = np.argsort(values)
    return values[order], rows["n"].to_numpy()[order]


def describe(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """``doc_id, text_id, set_id, n, sketch, lead`` per row; ``set_id`` is null for empty sets."""
    values, frequency = frequent

    def row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, led = WordNames(), set()
        for batch in slices(batches, "text"):
            shingles, n = shingle_sets(batch.column("text"), known, words)
            text = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(shingles), np.int64)
            if len(values):
                at = np.minimum(np.searchsorted(values, shingles), len(values) - 1)
                rank = np.where(values[at] == shingles, frequency[at], 0)
            order = np.lexsort((shingles, rank, text))
            place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            digest = digests(shingles, n)
            lead_n = np.where(n > 0, n - need(n, percent) + 1 + in_common(n), 0)
            for i, d in enumerate(digest.tolist()):  # copies met by one task lead once
                if d in led:
                    lead_n[i] = 0
                led.add(d)
            lead = shingles[order][place < np.repeat(lead_n, n)]
            sketch = sketches(shingles, n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_id"), pa.array(digest, mask=n == 0), pa.array(n.astype(np.int64)),
                 pa.array(sketch, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lead_n)]).astype(np.int32)),
                                          pa.array(lead.view(np.int64)))],
                names=["doc_id", "text_id", "set_id", "n", "sketch", "lead"])

    return docs.mapInArrow(row, "doc_id long, text_id long, set_id long, n long, sketch binary, lead array<long>")


def in_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut so that rows with equal ``column``, which are neighbours, stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut or (held and held[-1].column(column)[-1].as_py() != keys[0]):
            if cut:
                held.append(batch.slice(0, cut))
            yield _joined(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def shared_lists(leads: DataFrame) -> DataFrame:
    """``g, set_id, size``: the inverted lists in ``leads`` (``g, set_id``) with two classes or more, and their lengths."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "g"):
            g, s = batch.column("g").to_numpy(), batch.column("set_id").to_numpy()
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
            g, s = g[new], s[new]
            starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size = np.diff(np.append(starts, len(g)))
            size = np.repeat(size, size)
            many = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(g[many]), pa.array(s[many]), pa.array(size[many])],
                                             names=["g", "set_id", "size"])

    return leads.repartition("g").sortWithinPartitions("g", "set_id").mapInArrow(shared, "g long, set_id long, size long")


def likely_lists(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``lists`` without the classes that are in fewer of them than any link takes."""
    partner = F.ceil(F.col("n") * percent / 100)
    enough = lists.groupBy("set_id").agg(F.count(F.lit(1)).alias("shared")).join(classes.select("set_id", "n"), "set_id").filter(
        F.col("shared") > F.floor(partner * LEAD_PERCENT / 100)).select("set_id")
    return shared_lists(lists.select("g", "set_id").join(enough, "set_id", "left_semi"))


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (index of the smallest member) after joining the groups of ``a`` and ``b``, pair by pair."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            after = label[label]
            if (after == label).all():
                break
            label = after
    return label


class Sketches:
    """Sketches by class, all in one array."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, raw: list[bytes]) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], n[order]
        self.pool = np.frombuffer(b"".join(raw), _U)
        self.words = np.array([len(x) // 8 for x in raw], np.int64)
        self.first = (np.cumsum(self.words) - self.words)[order]
        self.words = self.words[order]

    def differences(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits that differ, pair by pair; the longer sketch is folded to the length of the shorter."""
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.words[a], self.words[b])
        for w in np.unique(width).tolist():
            here = np.flatnonzero(width == w)
            for at in range(0, len(here), 1 << 14):
                part = here[at:at + (1 << 14)]
                out[part] = np.bitwise_count(self._folded(a[part], w) ^ self._folded(b[part], w)).sum(axis=1, dtype=np.int64)
        return out

    def _folded(self, i: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(i), width), _U)
        for times in np.unique(self.words[i] // width).tolist():
            rows = np.flatnonzero(self.words[i] // width == times)
            for k in range(times):
                out[rows] ^= self.pool[self.first[i[rows]][:, None] + k * width + np.arange(width)]
        return out


def possible_groups(key: np.ndarray, place: np.ndarray, known: Sketches, percent: int) -> np.ndarray:
    """Per row the first row of its group: rows of one key are joined where sizes and sketches allow a link."""
    label = np.arange(len(key))
    row = np.arange(len(key))
    n = known.n[place]
    step = 1
    while True:
        row = row[row + step < len(key)]
        row = row[key[row] == key[row + step]]
        if not len(row):
            return label
        a, b = row, row + step
        fits = (label[a] != label[b]) & (np.maximum(n[a], n[b]) * percent <= np.minimum(n[a], n[b]) * 100)
        a, b = a[fits], b[fits]
        close = known.differences(place[a], place[b]) * (100 + percent) <= (n[a] + n[b]) * (100 - percent)
        label = merge_labels(label, a[close], b[close])
        step += 1


def possible_edges(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``u, v``: classes of one list that may link, joined to the first of their group.

    First every class of a list meets those of its own block, drawn anew for each list; then pairs of blocks meet, but for
    those that are connected by then.
    """
    blocks = F.ceil(F.col("size") / LIST_BLOCK)
    found = _dealt(lists.select("set_id", F.xxhash64("g", F.pmod(F.xxhash64("set_id", "g"), blocks)).alias("k")), classes, percent)
    long_lists = lists.filter(F.col("size") > LIST_BLOCK)
    if long_lists.isEmpty():
        return found
    spark, path, others = lists.sparkSession, fresh_dir(lists.sparkSession, "first-edges"), fresh_dir(lists.sparkSession, "blocks")
    found.write.parquet(path)
    found = spark.read.parquet(path)
    open_blocks(long_lists, components(found)).write.parquet(others)
    return found.unionAll(_dealt(spark.read.parquet(others), classes, percent)).distinct()


def open_blocks(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """``set_id, k``: the rows of ``lists`` in every pair of blocks that is not of one component alone.

    Lists are sorted by component before they are cut, so that a large component has blocks of its own.
    """
    known = lists.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "g", "set_id", F.coalesce("root", "set_id").alias("root"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("root", "set_id")) - 1
    cut = known.withColumn("block", F.floor(place / LIST_BLOCK))
    spark, path = lists.sparkSession, fresh_dir(lists.sparkSession, "numbered")
    cut.write.parquet(path)
    cut = spark.read.parquet(path)
    each = cut.groupBy("g", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    a, b = (each.select("g", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "low", "high")]) for x in "ab")
    pairs = a.join(b, "g").filter("block_a <= block_b AND NOT (low_a = high_b AND high_a = low_b AND low_a = high_a)")
    met = pairs.select("g", F.xxhash64("g", "block_a", "block_b").alias("k"),
                       F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    return cut.join(met, ["g", "block"]).select("set_id", "k")


def _dealt(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``u, v`` among the classes of one ``k``.

    ``rows`` (``set_id, k``) are dealt into shares of about ``LIST_SHARE``. A share gets the sketch of each of its classes once,
    ahead of its rows, which are read by ``k``.
    """
    shares = max(1, -(-rows.count() // LIST_SHARE))
    rows = rows.withColumn("share", F.pmod("k", F.lit(shares)).cast("int"))
    heads = rows.select("share", "set_id").distinct().join(classes.select("set_id", "n", "sketch"), "set_id")
    both = heads.select("share", F.lit(False).alias("listed"), F.lit(0).cast("long").alias("k"), "set_id", "n", "sketch").unionAll(
        rows.select("share", F.lit(True), "k", "set_id", F.lit(None).cast("long"), F.lit(None).cast("binary")))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in in_runs(batches, "k"):
            share, listed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("share", "listed"))
            new = (share[1:] != share[:-1]) | (listed[1:] != listed[:-1])
            cuts = np.flatnonzero(np.concatenate([[True], new, [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a)
                ids = part.column("set_id").to_numpy()
                if not listed[a]:
                    known = Sketches(ids, part.column("n").to_numpy(), part.column("sketch").to_pylist())
                    continue
                label = possible_groups(part.column("k").to_numpy(), np.searchsorted(known.ids, ids), known, percent)
                moved = np.flatnonzero(label != np.arange(len(label)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    return (both.repartition("share").sortWithinPartitions("share", "listed", "k", "set_id")
            .mapInArrow(edges, "u long, v long").filter("u <> v").distinct())


class Index:
    """Inverted index over sets; ``ask`` is one T-occurrence search."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.sets, self.percent = sets, percent
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.n)[order]
        flat = flat[order]
        self.starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1], [True]])) if len(flat) else np.zeros(1, np.int64)
        self.terms = flat[self.starts[:-1]]

    def ask(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """The sets among ``wanted`` (a mask) that link with set ``i``."""
        n = int(self.n[i])
        at = np.searchsorted(self.terms, self.sets[i])
        first, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        least = int(need(np.array([n]), self.percent)[0])
        order = np.argsort(-length, kind="stable")
        longest = int(length[order[0]])
        skip = min(least - 1, int(least / (0.01 * np.log2(longest + 1) + 1)) if longest > 64 else 0)
        long_, short = order[:skip], order[skip:]
        size = length[short]
        ends = np.cumsum(size)
        met = self.owner[np.repeat(first[short] - (ends - size), size) + np.arange(int(ends[-1]))]
        shared = np.bincount(met, minlength=len(self.sets))
        fits = wanted & (np.minimum(self.n, n) * 100 >= np.maximum(self.n, n) * self.percent)
        found = np.flatnonzero(fits & (shared >= max(1, least - skip)))
        shared = shared[found]
        for k in long_:
            if not len(found):
                break
            run = self.owner[first[k]:first[k] + length[k]]
            place = np.minimum(np.searchsorted(run, found), len(run) - 1)
            shared = shared + (run[place] == found)
        return found[shared * 100 >= (self.n[found] + n - shared) * self.percent]


def exact_labels(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Per set the smallest index of its component; with ``side``, only sets of different sides are compared."""
    index, label = Index(sets, percent), np.arange(len(sets))
    for i in range(len(sets)):
        wanted = label != label[i]
        if side is not None:
            wanted &= side != side[i]
        if wanted.any():
            found = index.ask(i, wanted)
            label = merge_labels(label, np.full(len(found), i), found)
    return label


def _spot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits that lets all of ``ids`` pass, and few others while they are few; packed."""
    marked = np.zeros(FILTER_BITS, bool)
    marked[ids.select(_spot(column).alias("i")).distinct().toArrow()["i"].to_numpy()] = True
    return np.packbits(marked)


def passes(column: str, bits: np.ndarray) -> Column:
    """Does the value pass a filter of :func:`id_filter`?"""

    @F.arrow_udf("boolean")
    def check(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy(zero_copy_only=False)
        return pa.array((bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool))

    return check(_spot(column))


def exact_edges(docs: DataFrame, members: DataFrame, words: int, percent: int, every: bool = False) -> DataFrame:
    """``u, v``: linked classes. ``members`` has ``doc_id`` of one document for each class, ``set_id, n, root``.

    Enough links to connect what is connected, or with ``every`` all of them.
    """
    wanted = id_filter(members, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, marked = WordNames(), np.unpackbits(wanted).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marked[batch.column("spot").to_numpy()]))
            for part in slices([batch], "text"):
                shingles, n = shingle_sets(part.column("text"), known, words)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(digests(shingles, n)),
                     pa.ListArray.from_arrays(offsets, pa.array(shingles.view(np.int64)))],
                    names=["doc_id", "set_id", "shingles"])

    made = docs.select("doc_id", _spot("doc_id").alias("spot"), "text").mapInArrow(
        sets, "doc_id long, set_id long, shingles array<long>")
    sizes = members.groupBy("root").agg(F.sum("n").alias("total"))
    members = (members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("total") / INDEX_BLOCK).cast("int"))
               .withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")))
    rows = made.join(members.select("doc_id", "set_id", "root", "own", "blocks"), ["doc_id", "set_id"])
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "set_id", "own", "shingles", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("k"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "k"):
            keys, ids = (batch.column(c).to_numpy() for c in ("k", "set_id"))
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
            batch = batch if new.all() else batch.filter(pa.array(new))
            keys, ids, own = (batch.column(c).to_numpy() for c in ("k", "set_id", "own"))
            flat, offsets = batch.column("shingles").flatten().to_numpy(), batch.column("shingles").offsets.to_numpy()
            offsets = offsets - offsets[0]  # a part of a batch keeps its place
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                here = [flat[x:y] for x, y in zip(offsets[a:b], offsets[a + 1:b + 1])]
                side = own[a:b] if own[a:b].min() != own[a:b].max() else None
                if every:
                    index = Index(here, percent)
                    pairs = [(i, j) for i in range(b - a) for j in index.ask(
                        i, (np.arange(b - a) > i) & (True if side is None else side != side[i])).tolist()]
                    x, y = np.array(pairs, np.int64).reshape(-1, 2).T + a
                else:
                    label = exact_labels(here, percent, side)
                    x = np.flatnonzero(label != np.arange(b - a))
                    x, y = x + a, label[x] + a
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["u", "v"])

    return rows.repartition("k").sortWithinPartitions("k", "set_id").mapInArrow(links, "u long, v long").distinct()


def _described(docs: DataFrame, id_column: str, text_column: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, text, text_id`` without nulls, the written rows of ``describe``)"""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("text_id", F.xxhash64("text"))
    path = fresh_dir(spark, "shingle-sets")
    describe(rows, frequent_shingles(rows, words), words, percent).write.parquet(path)
    return rows, spark.read.parquet(path)


def _links(rows: DataFrame, found: DataFrame, words: int, percent: int, every: bool = False) -> DataFrame:
    spark = rows.sparkSession
    sets = found.filter("set_id IS NOT NULL")
    classes = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    leads = sets.filter(F.size("lead") > 0).select(F.explode("lead").alias("g"), "set_id")
    path = fresh_dir(spark, "shared-lists")
    shared_lists(leads).write.parquet(path)
    lists = likely_lists(spark.read.parquet(path), classes, percent)
    path = fresh_dir(spark, "likely-lists")
    lists.write.parquet(path)
    lists, path = likely_lists(spark.read.parquet(path), classes, percent), fresh_dir(spark, "likely-lists")
    lists.write.parquet(path)
    roots = components(possible_edges(spark.read.parquet(path), classes, percent))
    roots = roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
    members = roots.select(F.col("node").alias("set_id"), "root").join(classes.select("set_id", "doc_id", "n"), "set_id")
    return exact_edges(rows, members, words, percent, every)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose sets reach ``percent`` % Jaccard are linked.

    Words are split at ASCII white space, A-Z in lower case; a set holds the distinct runs of ``words`` words, or the whole
    sequence of a shorter text. Null and wordless texts have an empty set and stand alone. The component is named by the
    smallest id in it, leaving nulls out. Rows that repeat are rows of one class; rows that share an id only are told apart
    by their sets. Other columns of ``docs`` are left out, whatever their names; an empty table stays empty.
    """
    doc_id = F.nullif("doc_id", F.lit(NO_ID))
    return components_by_row(docs, words, percent, id_column, text_column).select(
        doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", doc_id).alias("component_id"))


def components_by_row(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``doc_id, text_id, set_id, n, root, component_id`` of every row.

    ``text_id`` is the xxhash64 of the text's bytes. ``root`` tells components apart that have their smallest id in common; it
    is null, as is ``component_id``, for an empty set.
    """
    rows, found = _described(docs, id_column, text_column, words, percent)
    links = components(_links(rows, found, words, percent))
    # copies are added up on the map side first: what is sent to the components is one row per set
    sets = found.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.nullif("doc_id", F.lit(NO_ID))).alias("first"))
    least = sets.join(links.withColumnRenamed("node", "set_id"), "set_id", "left").select(
        "set_id", F.coalesce("root", "set_id").alias("root"), "first")
    named = least.groupBy("root").agg(F.min("first").alias("component_id"))
    # written, so that both sides of the last join are exchanged plainly and a set with many copies can be split
    path = fresh_dir(docs.sparkSession, "components-by-set")
    least.join(named, "root").select("set_id", "root", "component_id").write.parquet(path)
    described = found.select("doc_id", "text_id", "set_id", "n")
    joined = described.filter("set_id IS NOT NULL").join(docs.sparkSession.read.parquet(path), "set_id")
    empty = described.filter("set_id IS NULL").withColumns({c: F.lit(None).cast("long") for c in ("root", "component_id")})
    return joined.select(*empty.columns).unionAll(empty)


def without_near_copies(docs: DataFrame) -> DataFrame:
    """Of every component of near copies the document with the smallest id; documents without words all stay apart.

    Rows are told apart by id and text: rows that share an id only are decided one by one, and of those that are near copies
    of each other the text of smallest hash stays. A null id is larger than all others: it is stood in for by a number made
    from the text. The columns are those of ``docs``, which has ``doc_id`` and ``text``.
    """
    spark = docs.sparkSession
    key, text_id = "near_duplicates_key", "near_duplicates_text"
    made = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1))
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), made)).withColumn(
        text_id, F.xxhash64(F.col("text").cast("binary")))
    path = fresh_dir(spark, "near-duplicates")
    components_by_row(keyed.select(key, "text"), id_column=key).filter("root IS NOT NULL").select(
        F.col("doc_id").alias(key), F.col("text_id").alias(text_id), "root").write.parquet(path)
    grouped, firsts = fresh_dir(spark, "near-duplicates-grouped"), fresh_dir(spark, "near-duplicates-first")
    spark.read.parquet(path).groupBy(key, text_id).agg(
        F.min("root").alias("root"), F.count(F.lit(1)).alias("rows")).write.parquet(grouped)
    found = spark.read.parquet(grouped)
    found.groupBy("root").agg(F.min(F.struct(key, text_id)).alias("first")).write.parquet(firsts)
    stays = F.col("first") == F.struct(key, text_id)
    # both sides are read from tables, so a component of many documents can be split
    path = fresh_dir(spark, "near-duplicates-decided")
    found.join(spark.read.parquet(firsts), "root").select(key, text_id, stays.alias("stays"), "rows").write.parquet(path)
    found = spark.read.parquet(path)
    # only rows that may have to go, or that may repeat, are moved; all others stay where they are
    bits = id_filter(found.filter("NOT stays OR rows > 1"), key)
    doubtful = passes(key, bits) & F.coalesce(F.col("text").rlike(f"[^{SPACE_CLASS[1:-1]}]"), F.lit(False))
    kept = found.filter("stays").select(key, text_id)
    moved = keyed.filter(doubtful).join(kept, [key, text_id], "left_semi").dropDuplicates([key, text_id])
    return keyed.filter(~doubtful).unionByName(moved).select(*docs.columns)


def similar_pairs(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id",
                  text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(``u, v``: every pair of linked classes; ``doc_id, set_id, n``: the class of every document).

    The join itself: classes are sets, so copies are not expanded into pairs, and no link between different sets is missing.
    The pairs of a large group of near copies are as many as they are.
    """
    rows, found = _described(docs, id_column, text_column, words, percent)
    pairs = _links(rows, found, words, percent, every=True)
    return pairs, found.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "set_id", "n")
