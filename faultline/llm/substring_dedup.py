"""Exact removal of repeated passages by recompression.

A text is a string of word names. A round names the maximal runs of equal symbols, then deals all symbols into left and
right by a bit of their name and names every left-right pair, so the string shrinks by about a quarter. Names are 64-bit
digests of what they stand for: the same run or pair gets the same name everywhere without an exchange. Besides its words,
every symbol knows the span it depends on, that is, the words that had to be looked at to parse it so. Two equal passages
hold the same symbols wherever that span lies inside the passage: these are its consistent interior symbols.

A window of ``window`` words is represented by its interior symbol with the smallest digest of the span (by the window
itself, if it has none). Neighbouring windows share representatives, so there is about one row for a dozen words. Equal
windows have equal representatives, hence

* a representative that occurs once has no repeated window;
* one whose occurrences all carry the same digest of everything they represent has repeated windows only;
* windows of the others are compared one by one, by two digests of 64 bits.

The first two are decided by one aggregation over the representatives; only the third kind goes back to the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import WordNames, mix, pair_name, slices, split_words
from faultline.session import fresh_dir

WINDOW = 35
ROUNDS = 3
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Stands for a null id in joins.
_NO_ID = -(1 << 63)


class Spans:
    """Digests of any stretch of a string of names: differences of prefix sums, moved to a common power."""

    def __init__(self, names: np.ndarray, base: int) -> None:
        n = len(names)
        inverse = pow(base, -1, 1 << 64)
        powers = np.full(n + 1, base, _U)
        powers[0] = 1
        self.back = np.full(n + 1, inverse, _U)
        self.back[0] = 1
        powers, self.back = np.cumprod(powers), np.cumprod(self.back)
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(mix(names) * powers[:n])])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of names ``first`` up to, not including, ``last``."""
        return mix((self.sums[last] - self.sums[first]) * self.back[first] + (last - first).astype(_U))


class Symbols:
    """A string of symbols: name, text, first word, and the first and last word it depends on; all in text order."""

    def __init__(self, names: np.ndarray, text: np.ndarray) -> None:
        at = np.arange(len(names))
        self.name, self.text, self.start, self.low, self.high = names, text, at, at, at

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """What the symbol before and the symbol after depend on; beyond a text, one word outside it."""
        joined = self.text[1:] == self.text[:-1]
        before, after = self.low - 1, self.high + 1
        before[1:] = np.where(joined, self.low[:-1], before[1:])
        after[:-1] = np.where(joined, self.high[1:], after[:-1])
        return before, after

    def _take(self, first: np.ndarray, last: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.low, self.high = name, low, high
        self.text, self.start = self.text[first], self.start[first]

    def name_runs(self, salt: int) -> None:
        before, after = self._neighbours()
        same = (self.name[1:] == self.name[:-1]) & (self.text[1:] == self.text[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(first[1:], len(self.name)) - 1
        count = (last - first + 1).astype(_U)
        name = np.where(count > 1, pair_name(self.name[first], count, salt), self.name[first])
        self._take(first, last, name, before[first], after[last])

    def name_pairs(self, salt: int) -> None:
        before, after = self._neighbours()
        left = (mix(self.name + _U(salt)) >> _U(63)).astype(bool)
        paired = np.zeros(len(left), bool)
        paired[:-1] = left[:-1] & ~left[1:] & (self.text[1:] == self.text[:-1])
        second = np.concatenate([[False], paired[:-1]])
        first = np.flatnonzero(~second)
        pair = paired[first]
        last = first + pair
        name = np.where(pair, pair_name(self.name[first], self.name[last], salt + 1), self.name[first])
        low = np.where(pair | left[first], self.low[first], before[first])
        high = np.where(pair, self.high[last], np.where(left[first], after[first], self.high[first]))
        self._take(first, last, name, low, high)


def smallest(keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the leftmost smallest key in every range ``first`` to ``last``, both included."""
    table, out = np.arange(len(keys)), np.empty(len(first), np.int64)
    level = np.frexp(last - first + 1)[1] - 1
    for j in range(int(level.max()) + 1 if len(level) else 0):
        if j:
            a, b = table[:-(1 << (j - 1))], table[1 << (j - 1):]
            table = np.where(keys[a] <= keys[b], a, b)
        here = level == j
        a, b = table[first[here]], table[last[here] - (1 << j) + 1]
        out[here] = np.where(keys[a] <= keys[b], a, b)
    return out


def representatives(names: np.ndarray, counts: np.ndarray, window: int, rounds: int) -> dict[str, np.ndarray]:
    """``a`` (digest of the representative), ``s`` (digest of all it represents), ``text``, ``p`` (first window), ``c``
    (windows): rows cover every window of every text once; ``counts`` are the words of each text."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    here = np.arange(len(names))
    at = here[here + window <= ends[text]] if len(names) else here
    if not len(at):
        return {k: np.zeros(0, _U if k in "as" else np.int64) for k in ("a", "s", "text", "p", "c")}
    symbols = Symbols(names, text)
    for r in range(rounds):
        symbols.name_runs(3 * r + 1)
        symbols.name_pairs(3 * r + 2)
    one, two = (Spans(names, b) for b in _BASES)
    inside = (symbols.low >= (ends - counts)[symbols.text]) & (symbols.high < ends[symbols.text])
    inside &= symbols.high - symbols.low < window
    low, high = symbols.low[inside], symbols.high[inside]
    keys = one.of(low, high + 1)
    first, last = np.searchsorted(low, at), np.searchsorted(high, at + window - 1, side="right") - 1
    found = first <= last
    chosen = np.full(len(at), -1)
    if found.any():
        chosen[found] = smallest(keys, first[found], last[found])
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (chosen[1:] < 0) | (at[1:] != at[:-1] + 1)])
    rows = np.flatnonzero(new)
    c = np.diff(np.append(rows, len(at)))
    p, chosen = at[rows], chosen[rows]
    a = one.of(p, p + window) + _U(1)
    own = chosen >= 0
    a[own] = keys[chosen[own]]
    place = np.where(own, low[chosen] if len(low) else 0, p) - p
    s = mix(two.of(p, p + c + window - 1) + place.astype(_U))
    return {"a": a, "s": s, "text": text[p], "p": p - (ends - counts)[text[p]], "c": c}


def combined(key: np.ndarray, other: np.ndarray, text: np.ndarray, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """What one slice sends on: (key, other, text, p, c, sure).

    Rows that agree in both digests are repeats of each other whatever the rest of the corpus holds: they are sent on as
    sure stretches, adjacent ones in one, and one of them also speaks for all where the digests are compared. So no digest
    has more than one such row from a slice. Sure rows have a key of their own, to spread them.
    """
    order = np.lexsort((other, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (other[order][1:] != other[order][:-1])
    group = np.cumsum(new) - 1
    many = np.zeros(len(order), bool)
    many[order] = (np.bincount(group) > 1)[group] if len(order) else False
    speaks = np.sort(order[new])
    sure = np.flatnonzero(many)
    sure = sure[np.lexsort((p[sure], text[sure]))]
    apart = np.ones(len(sure), bool)
    apart[1:] = (text[sure][1:] != text[sure][:-1]) | (p[sure][1:] != p[sure][:-1] + c[sure][:-1])
    heads = np.flatnonzero(apart)
    stretch = np.add.reduceat(c[sure], heads) if len(heads) else c[:0]
    sure = sure[heads]
    own = mix(key[sure] + p[sure].astype(_U) * _U(_BASES[0]) + text[sure].astype(_U))
    rows = np.concatenate([speaks, sure])
    return (np.concatenate([key[speaks], own]), other[rows], text[rows], p[rows], np.concatenate([c[speaks], stretch]),
            np.arange(len(rows)) >= len(speaks))


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``d, h, text``: id (``_NO_ID`` for null), hash of the text, the text; rows that agree in all are the same to us."""
    text = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID)).alias("d"), F.hash(text).alias("h"), text.alias("text"))


def _occurrences(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNames()
        for batch in slices(batches, "text"):
            codes, words, counts = split_words(batch.column("text"))
            found = representatives(known.of(words)[codes], counts, window, rounds)
            a, digest, text, p, c, sure = combined(found["a"], found["s"], found["text"], found["p"], found["c"])
            text = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(digest.view(np.int64)), batch.column("d").take(text),
                 batch.column("h").take(text), pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sure)],
                names=["a", "s", "d", "h", "p", "c", "sure"])

    return rows.mapInArrow(name, "a long, s long, d long, h int, p int, c int, sure boolean")


def _again(found: DataFrame, keys: list[str], value: Column, label: str) -> DataFrame:
    """``keys, value`` of the keys that occur again among rows that are not ``sure``.

    Written, so that both sides of the join to come are exchanged plainly and a heavy key can be split.
    """
    path = fresh_dir(found.sparkSession, label)
    (found.filter("NOT sure").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), value.alias("value")).filter("n > 1")
     .select(*keys, "value").write.parquet(path))
    return found.sparkSession.read.parquet(path)


def _shared(rows: DataFrame, window: int, rounds: int) -> DataFrame:
    """``d, h, p, c, mixed``: stretches of windows whose representative occurs again; not ``mixed``: all are repeated."""
    found = _occurrences(rows, window, rounds)
    again = _again(found, ["a"], F.min("s") != F.max("s"), "representatives")
    return (found.select("a", "d", "h", "p", "c", "sure").join(again, "a", "left").filter("sure OR value IS NOT NULL")
            .select("d", "h", "p", "c", (~F.col("sure") & F.col("value")).alias("mixed")))


def _stretches(shared: DataFrame) -> DataFrame:
    """The stretches of a text, each once: rows that repeat id and text name the same ones, and only one of each is sent."""
    return shared.groupBy("d", "h").agg(F.collect_set(F.struct("p", "c")).alias("stretches"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, p, c) of arrays of structs; null arrays are empty."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()) if len(column) else 0)
    return row, flat.field("p").to_numpy(), flat.field("c").to_numpy()


def _windows(texts: DataFrame, mixed: DataFrame, window: int) -> DataFrame:
    """``x, y, d, h, p, c, sure``: two digests of the windows of the mixed stretches, one by one; sure ones in stretches."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordNames()
        for batch in slices(batches, "text"):
            codes, words, counts = split_words(batch.column("text"))
            names = known.of(words)[codes]
            row, p, c = _lists(batch.column("stretches"))
            start = (np.cumsum(counts) - counts)[row]
            at = np.repeat(p + start - np.cumsum(c) + c, c) + np.arange(int(c.sum()))
            text = np.repeat(row, c)
            x, y = (Spans(names, b).of(at, at + window) for b in _BASES)
            p = at - (np.cumsum(counts) - counts)[text]
            x, y, text, p, c, sure = combined(x, y, text, p, np.ones(len(p), np.int64))
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), batch.column("d").take(take),
                 batch.column("h").take(take), pa.array(p.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(sure)],
                names=["x", "y", "d", "h", "p", "c", "sure"])

    return (texts.join(_stretches(mixed), ["d", "h"]).select("d", "h", "text", "stretches")
            .mapInArrow(digest, "x long, y long, d long, h int, p int, c int, sure boolean"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, id_column: str = "doc_id",
                   text_column: str = "text", with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``): every text without the words of repeated windows.

    A window is repeated if its words start anywhere else in any text, also in a row that repeats id and text. Windows are
    judged on the input. Kept words are joined by one space. A null text has no words, a null id stays null, texts shorter
    than a window lose nothing; other columns of ``docs``, whatever their names, are left out. An empty table stays empty.
    """
    spark = docs.sparkSession
    path = fresh_dir(spark, "shared-stretches")
    texts = _keyed(docs, id_column, text_column)
    _shared(texts, window, rounds).write.parquet(path)
    shared = spark.read.parquet(path)
    windows = _windows(texts, shared.filter("mixed"), window)
    again = (windows.filter("NOT sure").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
             .select("x", "y", F.lit(True).alias("repeated")))
    hits = windows.join(again, ["x", "y"], "left").filter("sure OR repeated").select("d", "h", "p", "c")
    gone = _stretches(shared.filter("NOT mixed").select("d", "h", "p", "c").unionAll(hits))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, p, c = _lists(batch.column("stretches"))
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out: list[tuple] = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.split()
                n = len(words)
                if first[i] < first[i + 1]:
                    here = slice(first[i], first[i + 1])
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, p[here], 1)
                    np.add.at(edge, p[here] + c[here] + window - 1, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            names = ["d", "n_words", "n_removed", "kept_sha256", "kept"][:4 + with_text]
            yield pa.RecordBatch.from_arrays([batch.column("d"), *columns][:len(names)], names=names)

    schema = "d long, n_words long, n_removed long, kept_sha256 string" + (", kept binary" if with_text else "")
    result = texts.join(gone, ["d", "h"], "left").select("d", "text", "stretches").mapInArrow(strip, schema)
    doc_id: Column = F.nullif(F.col("d"), F.lit(_NO_ID))
    extra = [F.col("kept").cast("string").alias("kept")] if with_text else []
    return result.select(doc_id.alias("doc_id"), "n_words", "n_removed", "kept_sha256", *extra)
