"""Helpers shared by the training-data operators: words, 64-bit names, bounded slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

#: Words are runs of anything but these six characters; ``bytes.split()`` splits at exactly them.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class of Java and RE2 expressions.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Text taken at a time inside a task.
SLICE_BYTES = 4 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def pair_name(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name that depends on both names, on their order and on ``salt``."""
    return mix(mix(a + _U(salt)) * _U(0x9E3779B97F4A7C15) + b)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(code of every word of all texts, the distinct words by code, words of each text); texts are binary or null.

    Splitting at ASCII white space leaves an empty word where a text starts or ends with some; these are taken out.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, b"").view(pa.string()))
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.view(pa.binary()).to_pylist()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:
        keep = codes != words.index(b"")
        ends = np.cumsum(counts)
        kept = np.concatenate([[0], np.cumsum(keep)])
        counts, codes = kept[ends] - kept[ends - counts], codes[keep]
    return codes, words, counts


class WordNames:
    """64-bit names of words; the store is emptied when it is full."""

    def __init__(self, limit: int = 300_000) -> None:
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` (binary) holds about ``most`` bytes in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
