"""Language-model scores from Elias-Fano tries that Spark builds in shards.

The model: a word after a word has probability ``PAIRS c(u, w) / c(u) + (1 - PAIRS) p0(w)``, or ``p0(w)`` after a word that
training did not meet; ``p0(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))`` knows every word by name. All counts cover all training texts.

Texts are taken in slices. A slice sends each shard its distinct words (or word pairs) that belong there, with their counts
and the texts they occur in, as one packed row. A shard adds up the counts of all slices, builds its levels, looks up every
distinct word or pair, and sends each slice the sums for its texts.

A word belongs to the shard of its name. The ``FREQUENT`` most frequent words are also known to all by a broadcast table of
fixed size, which only decides where work is done. Pairs after a rare word go to the shard of that word, whose total is the
sum of its pairs; pairs of a frequent and a rare word go to the shard of the rare one, pairs of two frequent ones to any. Only
pairs of two rare words need one more step: the shard of the first looks up their share of its total and passes it on to the
shard of the second, which adds ``p0``.

Slices are named by input partition and number, so the input has to be read in the same order by the passes over it; the
last step checks that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import WordNames, mix, slices, split_words
from faultline.llm.ngram_join import in_runs
from faultline.llm.trie import Trie, WordLevel
from faultline.session import fresh_dir

#: Words that all tasks know with their counts; with START they have numbers of two bytes.
FREQUENT = (1 << 16) - 1
#: Shards at most: a word's shard is chosen by the 16 leading bits of its name.
SHARDS = 1 << 16
#: Names are at least this; smaller numbers are frequent words.
NAMES = np.uint64(1 << 17)
#: Weight of the pair's frequency against ``p0``.
PAIRS = 0.35
#: Bytes of text in a slice, and in the share of a shard.
SLICE = 4 << 20
SHARD = 12 << 20
#: Names of the end of a text, and of what precedes its first word.
END, START = np.uint64(0x9D1C3F5A7B2E4681), np.uint64(0x5851F42D4C957F2D)
_U = np.uint64
_ROW = "shard int, slice long, n int, docs binary, data binary"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers in few bytes: least width, bytes of equal weight together, compressed."""
    out = []
    for a in arrays:
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        planes = a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        data = zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)
        out += [len(a).to_bytes(6, "little") + bytes([width]) + len(data).to_bytes(6, "little"), data]
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        n, width = int.from_bytes(raw[at:at + 6], "little"), raw[at + 6]
        size = int.from_bytes(raw[at + 7:at + 13], "little")
        planes = np.frombuffer(zstandard.decompress(raw[at + 13:at + 13 + size]), np.uint8).reshape(width, n)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = planes.T
        out.append(full.view("<u8").ravel())
        at += 13 + size
    return out


def grouped(major: np.ndarray, minor: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (major, minor) with, for each, the documents that have it and how often: (major, minor, documents per
    pair, document, count)."""
    bits = [max(1, int(x.max()).bit_length()) if len(x) else 1 for x in (major, minor, doc)]
    if sum(bits) <= 63:
        key = np.sort((major.astype(np.int64) << (bits[1] + bits[2])) | (minor.astype(np.int64) << bits[2]) | doc)
        major, minor = key >> (bits[1] + bits[2]), (key >> bits[2]) & ((1 << bits[1]) - 1)
        doc = key & ((1 << bits[2]) - 1)
    else:
        order = np.lexsort((doc, minor, major))
        major, minor, doc = major[order], minor[order], doc[order]
    changed = np.ones(len(doc), bool)
    changed[1:] = (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])
    new = changed.copy()
    new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc)))
    first = np.flatnonzero(changed[at])
    return major[at][first], minor[at][first], np.diff(np.append(first, len(at))), doc[at], count


class Slice:
    """Words of some texts as codes: ``names`` by code, then END and START; ``code`` and ``doc`` of every token."""

    def __init__(self, batch: pa.RecordBatch, known: WordNames) -> None:
        lower = pc.ascii_lower(pc.fill_null(batch.column("text"), b"").view(pa.string())).view(pa.binary())
        codes, words, counts = split_words(lower)
        names = known.of(words)
        self.names = np.concatenate([np.where(names < NAMES, names + NAMES, names), [END, START]])
        end = len(words)
        self.n_tokens = counts + 1
        self.doc = np.repeat(np.arange(len(counts)), self.n_tokens)
        last = np.cumsum(self.n_tokens) - 1
        self.code = np.full(len(self.doc), end, np.int64)
        inner = np.ones(len(self.doc), bool)
        inner[last] = False
        self.code[inner] = codes
        self.before = np.full(len(self.doc), end + 1, np.int64)
        self.before[1:] = self.code[:-1]
        self.before[last[:-1] + 1] = end + 1
        if len(counts):
            self.before[0] = end + 1
        self.trained = ~np.array(batch.column("held_out").to_pylist(), bool)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Slice]]:
    from pyspark import TaskContext

    known, number = WordNames(), TaskContext.get().partitionId() << 32
    for batch in slices(batches, "text", SLICE):
        yield number, batch, Slice(batch, known)
        number += 1


def _shares(shard: np.ndarray, per_key: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, its keys, their postings) for every shard that has keys."""
    order = np.argsort(shard, kind="stable")
    starts = np.cumsum(per_key) - per_key
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0, [True]])) if len(order) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        keys = order[a:b]
        n = per_key[keys]
        yield int(shard[keys[0]]), keys, np.repeat(starts[keys] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                      names=["shard", "slice", "n", "docs", "data"])


def _trained_counts(per_key: np.ndarray, doc: np.ndarray, count: np.ndarray, trained: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(np.where(trained[doc], count, 0))])
    ends = np.cumsum(per_key)
    return total[ends] - total[ends - per_key]


def _word_shard(names: np.ndarray, shards: int) -> np.ndarray:
    return ((names >> _U(48)) % _U(shards)).astype(np.int64)


def word_rows(texts: DataFrame, shards: int) -> DataFrame:
    """Each slice's words by shard; the row of one shard also names the slice's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, s in _slices(batches):
            _, code, per_key, doc, count = grouped(np.zeros(len(s.doc), np.int64), s.code, s.doc)
            names = s.names[code]
            known = _trained_counts(per_key, doc, count, s.trained)
            docs = packed(batch.column("doc_id").fill_null(0).to_numpy().view(_U), np.array(batch.column("doc_id").is_null()),
                          s.n_tokens, s.trained)
            out = [(share, number, batch.num_rows, None,
                    packed(names[keys], known[keys], per_key[keys], doc[posts], count[posts]))
                   for share, keys, posts in _shares(_word_shard(names, shards), per_key)]
            yield _rows([*out, (number % shards, number, batch.num_rows, docs, None)])

    return texts.mapInArrow(run, _ROW)


def pair_rows(texts: DataFrame, shards: int, words: Words) -> DataFrame:
    """Each slice's word pairs by shard; a row holds pairs of which all contexts, and all words, are frequent or rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch, s in _slices(batches):
            before, code, per_key, doc, count = grouped(s.before, s.code, s.doc)
            name = words.numbered(s.names)
            context, word = name[before], name[code]
            known = _trained_counts(per_key, doc, count, s.trained)
            rare_context, rare = context >= NAMES, word >= NAMES
            place = np.where(rare_context, mix(context), mix((context << _U(16)) ^ word)) % _U(shards)
            place = np.where(rare & ~rare_context, _word_shard(word, shards), place.astype(np.int64))
            out = []
            for share, keys, posts in _shares(place * 4 + rare_context * 2 + rare, per_key):
                runs = np.flatnonzero(np.concatenate([[True], before[keys][1:] != before[keys][:-1]]))
                out.append((share >> 2, number, batch.num_rows, None, packed(
                    context[keys][runs], np.diff(np.append(runs, len(keys))), word[keys], known[keys], per_key[keys],
                    doc[posts], count[posts])))
            yield _rows(out)

    return texts.mapInArrow(run, _ROW)


def _by_shard(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(rows of one shard)`` over all shards."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "shard"):
            keys = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield from run(batch.slice(a, b - a))

    return rows.repartition("shard").sortWithinPartitions("shard", "slice").mapInArrow(each, schema)


def _sums(batch: pa.RecordBatch, data: list[list[np.ndarray]], value: np.ndarray, known: np.ndarray) -> list[tuple]:
    """Per slice: sums over its documents of ``value`` and ``known`` of the keys, which are those of all slices in turn."""
    out, at = [], 0
    for number, n, (per_key, doc, count) in zip(batch.column("slice").to_pylist(), batch.column("n").to_pylist(), data):
        key = np.repeat(np.arange(at, at + len(per_key)), per_key)
        sums = np.bincount(doc, value[key] * count, n)
        met = np.bincount(doc, known[key] * count, n)
        out.append((0, number, n, None, zstandard.compress(np.stack([sums, met]).astype("<f8").tobytes(), 1)))
        at += len(per_key)
    return out


def count_words(texts: DataFrame, shards: int) -> DataFrame:
    """Rows of four kinds, by ``kind``: ``0`` the sums of a slice, ``1`` a frequent word (``a`` its name, ``b`` its count),
    ``2`` the totals of a shard (``a`` tokens, ``b`` words), ``3`` all words of a shard with their counts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        def made(kind: int, rows: pa.RecordBatch, *abc: np.ndarray) -> pa.RecordBatch:
            full = [pa.array(x, pa.int64()) for x in abc] + [pa.nulls(rows.num_rows, pa.int64())] * (2 - len(abc))
            return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns, *full],
                                              names=["kind", *rows.schema.names, "a", "b"])

        headers = batch.filter(pc.is_null(batch.column("data")))
        yield made(0, headers)
        batch = batch.filter(pc.is_valid(batch.column("data")))
        if not batch.num_rows:
            return
        data = [unpacked(x) for x in batch.column("data").to_pylist()]
        names, inverse = np.unique(np.concatenate([x[0] for x in data]), return_inverse=True)
        count = np.bincount(inverse, np.concatenate([x[1] for x in data]).astype(float), len(names))
        yield made(0, _rows(_sums(batch, [[y.astype(np.int32) for y in x[2:]] for x in data],
                                  np.log10(count + 0.5)[inverse], (count > 0).astype(float)[inverse])))
        seen = count > 0
        names, count = names[seen], count[seen].astype(np.int64)
        best = np.argsort(-count, kind="stable")[:FREQUENT]
        best = best[count[best] > 1]
        yield made(1, _rows([(0, 0, 0, None, None)] * len(best)), names[best].view(np.int64), count[best])
        yield made(2, _rows([(0, 0, 0, None, None)]), np.array([count.sum()]), np.array([len(count)]))
        yield made(3, _rows([(batch.column("shard")[0].as_py(), -1, 0, None, packed(names, count))]))

    return _by_shard(word_rows(texts, shards), run, f"kind int, {_ROW}, a long, b long")


class Words:
    """Totals of the lower order, and the frequent words with their counts."""

    def __init__(self, names: np.ndarray, count: np.ndarray, tokens: int, types: int, starts: int) -> None:
        order = np.argsort(names)
        self.names, self.n, self.v = names[order], tokens, types
        self.totals = np.append(count[order], starts).astype(float)
        self.whole = tokens + 0.5 * (types + 1)
        self.unknown = 0.5 / self.whole

    def numbered(self, names: np.ndarray) -> np.ndarray:
        """Frequent words and START by their number, other words by name."""
        out = names
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            out = np.where(self.names[at] == names, at.astype(_U), names)
        return np.where(names == START, _U(len(self.names)), out)

    def level(self, batch: pa.RecordBatch) -> tuple[WordLevel, pa.RecordBatch]:
        """The level of the shard's rare words, and the rows other than that of the words."""
        own = pc.less(batch.column("slice"), 0)
        names, count = np.zeros(0, _U), np.zeros(0, _U)
        for raw in batch.filter(own).column("data").to_pylist():
            names, count = unpacked(raw)
        rare = self.numbered(names) >= NAMES
        level = WordLevel(WordLevel.build(names[rare], np.log10((count[rare].astype(float) + 0.5) / self.whole)))
        return level, batch.filter(pc.invert(own))

    def p0(self, word: np.ndarray, level: WordLevel) -> np.ndarray:
        """Of words by number, or by name if ``level`` is that of their shard."""
        out = np.empty(len(word))
        frequent = word < NAMES
        out[frequent] = (self.totals[word[frequent].astype(np.int64)] + 0.5) / self.whole
        found = level.ask(word[~frequent])
        out[~frequent] = np.where(np.isnan(found), self.unknown, 10 ** found)
        return out

    def total(self, context: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Training tokens after each context: known for frequent words, else as ``found`` in the shard."""
        return np.where(context < NAMES, self.totals[np.minimum(context, _U(len(self.names))).astype(np.int64)], found)


def build_shard(context: np.ndarray, word: np.ndarray, count: np.ndarray, words: Words):
    """The trie of pairs that were seen, sorted by context, then word: their share of the context's total by ``PAIRS``."""
    contexts, starts = np.unique(context, return_index=True)
    total = words.total(contexts, np.add.reduceat(count, starts) if len(starts) else np.zeros(0))
    seen = np.log10(PAIRS * count / np.repeat(total, np.diff(np.append(starts, len(context)))))
    return Trie.build(context, word, seen, {"context": contexts, "value": np.full(len(contexts), math.log10(1 - PAIRS))})


def _pairs(batch: pa.RecordBatch) -> tuple[list[list[np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """(per slice [documents per key, document, count]; context, word and training count of every key)"""
    data, context, word, count = [], [], [], []
    for raw in batch.column("data").to_pylist():
        names, runs, w, known, *rest = unpacked(raw)
        context.append(np.repeat(names, runs.astype(np.int64)))
        word.append(w)
        count.append(known)
        data.append([x.astype(np.int32) for x in rest])
    none = np.zeros(0, _U)
    return (data, np.concatenate([none, *context]), np.concatenate([none, *word]), np.concatenate([none, *count]).astype(float))


def _distinct(context: np.ndarray, word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """(context, word, count of each distinct pair in order; which pair every key is)"""
    order = np.lexsort((word, context))
    c, w = context[order], word[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    pair = np.cumsum(new) - 1
    inverse = np.empty(len(c), np.int64)
    inverse[order] = pair
    return c[new], w[new], np.bincount(pair, count[order], int(new.sum())), inverse


def score_pairs(texts: DataFrame, shards: int, words: Words, counted: DataFrame) -> DataFrame:
    """``kind`` 0: per slice and shard the sums of log probabilities, by looking up every pair in the shard's trie; ``kind`` 1:
    the shares of pairs of rare words for the shard of the second. ``counted``: the words of each shard."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard = batch.column("shard")[0].as_py()
        level, batch = words.level(batch)
        if not batch.num_rows:
            return
        data, *keys = _pairs(batch)
        context, word, count, inverse = _distinct(*keys)
        seen = count > 0
        found, backoff = Trie(build_shard(context[seen], word[seen], count[seen], words)).ask(context, word)
        # a frequent context may be missing from a shard's trie, but its total is known
        met = (backoff < 0) | (words.total(context, np.zeros(len(context))) > 0)
        share = np.where(np.isnan(found), 0, 10 ** found)
        rare = (context >= NAMES) & (word >= NAMES)
        value = np.zeros(len(word))
        value[~rare] = np.log10(share[~rare] + np.where(met[~rare], 1 - PAIRS, 1) * words.p0(word[~rare], level))
        at = np.cumsum([0] + [len(x[0]) for x in data])
        passed = np.array([len(x[0]) > 0 and rare[inverse[a]] for x, a in zip(data, at[:-1])], bool)
        here = [i for i in range(len(data)) if not passed[i]]
        part = np.concatenate([np.zeros(0, np.int64), *(inverse[at[i]:at[i + 1]] for i in here)])
        sums = _sums(batch.take(pa.array(here, pa.int64())), [data[i] for i in here], value[part], np.zeros(len(part)))
        yield _kind(0, _rows(sums))
        yield _kind(1, _rows(list(_passed_on(batch, data, at, inverse, np.flatnonzero(passed), word, share, met, shard, shards))))

    return _by_shard(pair_rows(texts, shards, words).unionAll(counted), run, f"kind int, {_ROW}")


def _kind(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, kind, np.int32)), *rows.columns],
                                      names=["kind", *rows.schema.names])


def _passed_on(batch: pa.RecordBatch, data: list, at: np.ndarray, inverse: np.ndarray, chosen: np.ndarray, word: np.ndarray,
               share: np.ndarray, met: np.ndarray, shard: int, shards: int) -> Iterator[tuple]:
    """A row per shard of second words: each distinct pair of the ``chosen`` rows once, with all its postings."""
    if not len(chosen):
        return
    per_key = np.concatenate([data[i][0] for i in chosen])
    pair = np.repeat(np.concatenate([inverse[at[i]:at[i + 1]] for i in chosen]), per_key)
    row = np.repeat(np.arange(len(chosen)), [len(data[i][1]) for i in chosen])
    doc, count = (np.concatenate([data[i][k] for i in chosen]) for k in (1, 2))
    to = _word_shard(word, shards)
    order = np.lexsort((row, pair, to[pair]))
    pair, row, doc, count = pair[order], row[order], doc[order], count[order]
    numbers, sizes = (batch.column(x).to_numpy()[chosen] for x in ("slice", "n"))
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(to[pair]) != 0, [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        own, posts = np.unique(pair[a:b], return_counts=True)
        rows, where = np.unique(row[a:b], return_inverse=True)
        yield (int(to[own[0]]), shard, 0, None, packed(
            word[own], share[own].astype("<f4").view("<u4"), met[own], posts, where, doc[a:b], count[a:b], numbers[rows], sizes[rows]))


def score_rare_pairs(passed: DataFrame, words: Words, counted: DataFrame) -> DataFrame:
    """Per slice and shard the log probabilities of pairs of rare words: documents that have some, and their sums."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        level, batch = words.level(batch)
        parts, size = [], {}
        for raw in batch.column("data").to_pylist():
            word, share, met, posts, where, doc, count, numbers, sizes = unpacked(raw)
            numbers = numbers.astype(np.int64)
            size.update(zip(numbers.tolist(), sizes.tolist()))
            p = share.astype("<u4").view("<f4") + np.where(met > 0, 1 - PAIRS, 1) * words.p0(word, level)
            value = np.repeat(np.log10(p), posts.astype(np.int64)) * count
            # one entry per document of a slice
            number = numbers[where.astype(np.int64)]
            order = np.lexsort((doc, number))
            parts.append(_added(number[order], doc[order].astype(np.int64), value[order]))
        if not parts:
            return
        number, doc, value = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, number))
        number, doc, value = _added(number[order], doc[order], value[order])
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(number) != 0, [True]]))
        yield _rows([(0, int(number[a]), size[int(number[a])], None, packed(doc[a:b], value[a:b].astype("<f8").view("<u8")))
                     for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])

    return _by_shard(passed.unionAll(counted), run, _ROW)


def _added(number: np.ndarray, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of neighbours with equal (number, doc)."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(number) != 0) | (np.diff(doc) != 0)]))
    return number[first], doc[first], np.add.reduceat(value, first)


def tries(docs: DataFrame) -> DataFrame:
    """``shard, trie, words``: the model itself, buffers for ``Trie`` and ``WordLevel`` per shard."""
    texts, shards, words, _, counted = _trained(docs)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        shard = batch.column("shard").slice(0, 1)
        level, batch = words.level(batch)
        _, *keys = _pairs(batch)
        context, word, count, _ = _distinct(*keys)
        seen = count > 0
        buffer = build_shard(context[seen], word[seen], count[seen], words)
        yield pa.RecordBatch.from_arrays([shard, pa.array([buffer[:]], pa.binary()), pa.array([level.buffer[:]], pa.binary())],
                                         names=["shard", "trie", "words"])

    return _by_shard(pair_rows(texts, shards, words).unionAll(counted), run, "shard int, trie binary, words binary")


def _trained(docs: DataFrame) -> tuple[DataFrame, int, Words, DataFrame, DataFrame]:
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))
    texts = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n"), F.count_if(~F.col("held_out")).alias("starts")).first()
    shards = max(1, min(SHARDS, -(-(size["n"] or 0) // SHARD)))
    path = fresh_dir(spark, "words")
    count_words(texts, shards).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(f"{_ROW}, a long, b long, kind int").parquet(path)
    top = stored.filter("kind = 1").select("a", "b").orderBy(F.col("b").desc(), "a").limit(FREQUENT).toArrow()
    total = stored.filter("kind = 2").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("v")).first()
    words = Words(top["a"].to_numpy().view(_U), top["b"].to_numpy(), total["n"], total["v"], size["starts"])
    columns = ["shard", "slice", "n", "docs", "data"]
    return (texts, shards, words, stored.filter("kind = 0").select(*columns[1:]),
            stored.filter("kind = 3").select(*columns))


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Trained on the documents whose crc32 of the id as text leaves no 1 by 5; a null id is trained on. A-Z in lower case,
    words split at ASCII white space, and one end per text; a null text has the end only. ``base_score``: every token by its
    smoothed count alone. ``score``: log10 probability by the model, its terms within 0.02 by quantisation. Rows that repeat are rows of their own; other columns
    are left out, whatever their names; an empty table stays empty.
    """
    spark = docs.sparkSession
    texts, shards, words, base, counted = _trained(docs)
    path = fresh_dir(spark, "pairs")
    score_pairs(texts, shards, words, counted).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(f"{_ROW}, kind int").parquet(path)
    rare = score_rare_pairs(stored.filter("kind = 1").drop("kind"), words, counted)
    kinds = (base, stored.filter("kind = 0"), rare)
    first, *rest = (x.select("slice", "n", "docs", "data", F.lit(kind).alias("kind")) for kind, x in enumerate(kinds))
    rows = first.unionAll(rest[0]).unionAll(rest[1])
    per_token = math.log10(words.n + 0.5 * (words.v + 1))
    n_train = words.n

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_runs(batches, "slice"):
            keys = batch.column("slice").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(a, b - a).to_pylist()
                n = part[0]["n"]
                if any(r["n"] != n for r in part) or sum(r["docs"] is not None for r in part) != 1:
                    raise ValueError("the input was read in different orders; write it to a table first")
                ids, null, tokens, trained = unpacked(next(r["docs"] for r in part if r["docs"] is not None))
                sums = np.zeros((2, 2, n))
                for r in part:
                    if r["data"] is not None and r["kind"] == 2:
                        doc, value = unpacked(r["data"])
                        sums[1, 0, doc.astype(np.int64)] += value.view("<f8")
                    elif r["data"] is not None:
                        sums[r["kind"]] += np.frombuffer(zstandard.decompress(r["data"]), "<f8").reshape(2, n)
                tokens = tokens.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids.view(np.int64), mask=null.astype(bool)), pa.array(~trained.astype(bool)), pa.array(tokens),
                     pa.array(np.rint(sums[0, 1]).astype(np.int64)), pa.array(np.full(n, n_train, np.int64)),
                     pa.array(sums[0, 0] - tokens * per_token), pa.array(sums[1, 0])],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return rows.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
