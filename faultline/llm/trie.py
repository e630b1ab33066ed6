"""Compact tries of order two: Elias-Fano levels and quantised log probabilities in one mapped buffer."""

from __future__ import annotations

import json
import mmap

import numpy as np

_U = np.uint64
_PLACE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [_bit for _bit in range(8) if _byte >> _bit & 1]
    _PLACE[_byte, :len(_ones)] = _ones


def _padded(raw: np.ndarray) -> np.ndarray:
    return np.concatenate([raw, np.zeros(16 - len(raw) % 8, np.uint8)])


class EliasFano:
    """A sorted sequence of unsigned integers: low bits packed, high bits as unary gaps with counts per word."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.windows = np.ndarray(max(0, len(low) - 7), "<u8", low, 0, (1,))

    @staticmethod
    def build(values: np.ndarray) -> tuple[dict[str, int], list[np.ndarray]]:
        values = values.astype(_U)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(1, n)).bit_length() - 1))
        step = 1 << 15  # a multiple of 8, so that parts end at whole bytes
        low = [np.packbits(((values[i:i + step, None] >> np.arange(bits, dtype=_U)) & _U(1)).astype(np.uint8).ravel(), bitorder="little")
               for i in range(0, n, step)]
        set_at = (values >> _U(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(set_at[-1]) if n else 0) + 2, np.uint8)
        flags[set_at] = 1
        high = _padded(np.packbits(flags, bitorder="little"))
        words = high.view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]]).astype("<u4" if n < 1 << 32 else "<u8")
        return {"n": n, "bits": bits}, [_padded(np.concatenate([np.zeros(0, np.uint8), *low])), high, ones.view(np.uint8)]

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one, or zero, in the high bits."""
        words = self.high.view("<u8")
        before = np.arange(len(words)) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        left = k - before[word]
        value = ~words[word] if zeros else words[word]
        place = word * 64
        for _ in range(7):  # to the byte
            count = np.bitwise_count(value & _U(255))
            over = left >= count
            if not over.any():
                break
            left = left - np.where(over, count, 0)
            place = place + np.where(over, 8, 0)
            value = np.where(over, value >> _U(8), value)
        return place + _PLACE[(value & _U(255)).astype(np.int64), left]

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.windows[at >> 3] >> (at & 7).astype(_U)) & _U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, False) - i).astype(_U) << _U(self.bits)) | self._low(i)

    def find(self, values: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """Index of each value among the items ``first`` up to ``last`` (all, if not given); -1 where it is missing."""
        out = np.full(len(values), -1)
        if not self.n or not len(values):
            return out
        bucket = (values >> _U(self.bits)).astype(np.int64)
        most = len(self.high) * 8 - self.n - 1
        here = np.flatnonzero((bucket < most) & (values >> _U(self.bits) < _U(1 << 62)))
        bucket, want = bucket[here], values[here] & _U((1 << self.bits) - 1)
        high = self._select(bucket, True) - bucket
        low = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), True) - np.maximum(bucket - 1, 0), 0)
        if first is not None and last is not None:
            low, high = np.maximum(low, first[here]), np.minimum(high, last[here])
        end = np.minimum(high, self.n)
        low, high = np.minimum(low, end), end.copy()
        while True:  # successor of the low bits inside the bucket
            open_ = low < high
            if not open_.any():
                break
            middle = (low + high) >> 1
            less = np.zeros(len(low), bool)
            less[open_] = self._low(middle[open_]) < want[open_]
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        hit = low < end
        hit[hit] = self._low(low[hit]) == want[hit]
        out[here[hit]] = low[hit]
        return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, 256 levels): levels are means of equally wide bins, so no value is off by more than a 256th of
    the range; few distinct values stay exact."""
    distinct, inverse = np.unique(values, return_inverse=True)
    if len(distinct) <= 256:
        return inverse.astype(np.uint8), np.concatenate([distinct, np.zeros(256 - len(distinct))])
    code = np.searchsorted(np.linspace(distinct[0], distinct[-1], 257)[1:-1], values, side="right")
    count = np.bincount(code, minlength=256)
    return code.astype(np.uint8), np.bincount(code, values, 256) / np.maximum(count, 1)


def _stored(header: dict, parts: list[np.ndarray]) -> mmap.mmap:
    """One mapped buffer: length of the header, header, parts at multiples of eight."""
    header["lengths"] = [len(p) for p in parts]
    head = json.dumps(header).encode()
    out = mmap.mmap(-1, 16 + len(head) + sum(len(p) + 8 for p in parts))
    out.write(len(head).to_bytes(8, "little") + head)
    for p in parts:
        out.write(b"\0" * (-out.tell() % 8))
        out.write(p.tobytes())
    return out


def _loaded(buffer: bytes | mmap.mmap) -> tuple[dict, list[np.ndarray]]:
    raw = np.frombuffer(buffer, np.uint8)
    size = int(raw[:8].view("<u8")[0])
    header = json.loads(raw[8:8 + size].tobytes())
    at, parts = 8 + size, []
    for length in header["lengths"]:
        at += -at % 8
        parts.append(raw[at:at + length])
        at += length
    return header, parts


def _level(kind: dict[str, int], low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> EliasFano:
    return EliasFano(kind["n"], kind["bits"], low, high, ones.view("<u4" if kind["n"] < 1 << 32 else "<u8"))


class WordLevel:
    """The level of single words: their names, and a quantised log probability for each."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        self.buffer = buffer
        header, (low, high, ones, self.codes, levels) = _loaded(buffer)
        self.names, self.levels = _level(header["names"], low, high, ones), levels.view("<f8")

    @staticmethod
    def build(names: np.ndarray, values: np.ndarray) -> mmap.mmap:
        """From sorted distinct names."""
        kind, parts = EliasFano.build(names)
        codes, levels = quantised(values)
        return _stored({"names": kind}, [*parts, codes, levels.astype("<f8").view(np.uint8)])

    def ask(self, names: np.ndarray) -> np.ndarray:
        """Log probabilities, NaN for names that are not here."""
        at = self.names.find(names)
        out = np.full(len(names), np.nan)
        out[at >= 0] = self.levels[self.codes[at[at >= 0]]]
        return out


class Trie:
    """Contexts, and under each the words that followed it.

    Levels: names of contexts, names of words, pointers from a context to its words, and the words' numbers, each raised
    by the last one of the context before so that the whole level is sorted. A lookup is a successor search among the
    words of one context, relative to that context's base.
    """

    LEVELS = ("contexts", "words", "pointers", "children")

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        self.header, parts = _loaded(buffer)
        for i, name in enumerate(self.LEVELS):
            setattr(self, name, _level(self.header[name], *parts[3 * i:3 * i + 3]))
        self.seen, self.backoff = parts[12], parts[13]
        self.seen_levels, self.backoff_levels = parts[14].view("<f8"), parts[15].view("<f8")

    @staticmethod
    def build(context: np.ndarray, word: np.ndarray, seen: np.ndarray, backoff: dict[str, np.ndarray]) -> mmap.mmap:
        """From pairs sorted by context, then word, with their log probabilities; ``backoff``: ``context`` (sorted, the
        distinct ones) and ``value``."""
        contexts, starts = backoff["context"], np.searchsorted(context, backoff["context"])
        words, number = np.unique(word, return_inverse=True)
        pointers = np.append(starts, len(context))
        last = number[pointers[1:] - 1].astype(np.int64) + 1 if len(contexts) else np.zeros(0, np.int64)
        base = np.cumsum(last) - last
        children = number + np.repeat(base, np.diff(pointers))
        header: dict = {}
        parts: list[np.ndarray] = []
        for name, values in zip(Trie.LEVELS, (contexts, words, pointers, children)):
            header[name], arrays = EliasFano.build(values)
            parts += arrays
        codes, levels = quantised(seen)
        back, back_levels = quantised(backoff["value"])
        parts += [codes, back, levels.astype("<f8").view(np.uint8), back_levels.astype("<f8").view(np.uint8)]
        return _stored(header, parts)

    def ask(self, context: np.ndarray, word: np.ndarray, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of pairs that were seen, else NaN; backoff of the context, 0 where it was not seen)."""
        parts = [self._ask(context[i:i + step], word[i:i + step]) for i in range(0, len(context), step)]
        return tuple(np.concatenate([np.zeros(0), *x]) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0))

    def _ask(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, backoff = np.full(len(context), np.nan), np.zeros(len(context))
        at = self.contexts.find(context)
        known = np.flatnonzero(at >= 0)
        at = at[known]
        backoff[known] = self.backoff_levels[self.backoff[at]]
        number = self.words.find(word[known])
        known, at, number = known[number >= 0], at[number >= 0], number[number >= 0]
        first, last = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base = np.where(first > 0, self.children.get(np.maximum(first - 1, 0)).astype(np.int64) + 1, 0)
        place = self.children.find((base + number).astype(_U), first, last)
        hit = place >= 0
        seen[known[hit]] = self.seen_levels[self.seen[place[hit]]]
        return seen, backoff
