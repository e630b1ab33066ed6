"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at unit borders, and the parts are put in another order.

A unit is a word with the white space before it; white space at the end of a text is a unit of its own. A text is cut into
blocks of ``BLOCK`` bytes; a Fenwick tree over its blocks holds how many units end in them and how many code points begin
there. A binary-lifting descent finds the block where the k-th unit ends, and only that block is searched for the border.
The trees of all texts of a batch lie one after the other, so building them and all descents are array operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from faultline.llm.common import SLICE_BYTES, SPACES, ragged, slices

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, so many are transformed, and of 100 of these so many put the suffix first.
RATE = 50
SPM_RATE = 80
SEED = "42"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_WORD = np.ones(256, bool)
_WORD[list(SPACES.encode())] = False

_FIELDS = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType())]


class Blocks:
    """Fenwick trees over the blocks of several texts that lie one after the other in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        lengths = np.diff(offsets)
        self.blocks = -(-lengths // BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        within = ragged(np.zeros(len(lengths), np.int64), self.blocks)
        self.starts = np.repeat(offsets[:-1], self.blocks) + within * BLOCK
        self.lasts = np.repeat(offsets[1:], self.blocks)  # end of the block's text
        self.stops = np.minimum(self.starts + BLOCK, self.lasts)
        units, points = self._counts()
        up = within + 1
        low = up & (up - 1)
        base = np.repeat(self.first, self.blocks)
        self.units, self.points = (self._tree(x, base, up, low) for x in (units, points))
        sums = np.concatenate([[0], np.cumsum(units)])
        self.n = sums[self.first + self.blocks] - sums[self.first]

    @staticmethod
    def _tree(counts: np.ndarray, base: np.ndarray, up: np.ndarray, low: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(counts)])
        return sums[base + up] - sums[base + low]

    def _ends(self, at: np.ndarray, stop_of_text: np.ndarray) -> np.ndarray:
        """Whether a unit ends with the byte at each place."""
        last = at + 1 == stop_of_text
        after = self.data[np.where(last, at, at + 1)]
        return last | (_WORD[self.data[at]] & ~_WORD[after])

    def _counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(units that end, code points that begin) in every block, some megabytes at a time."""
        units, points = np.zeros(len(self.starts), np.int64), np.zeros(len(self.starts), np.int64)
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(self.stops, self.starts[a] + SLICE_BYTES, "right")))
            lo, hi = int(self.starts[a]), int(self.stops[b - 1])
            data = self.data[lo:hi]
            word = _WORD[data]
            ends = np.zeros(hi - lo, np.int8)
            ends[:-1] = word[:-1] & ~word[1:]
            if hi < len(self.data):
                ends[-1] = word[-1] and not _WORD[self.data[hi]]
            ends[(self.stops[a:b] - 1 - lo)[self.stops[a:b] == self.lasts[a:b]]] = 1
            cuts = self.starts[a:b] - lo
            units[a:b] = np.add.reduceat(ends, cuts, dtype=np.int64)
            points[a:b] = np.add.reduceat((data & 0xC0 != 0x80).view(np.int8), cuts, dtype=np.int64)
            a = b
        return units, points

    def borders(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, code points) before the end of unit ``k`` of each ``text``; 0 for k = 0. k is at most ``n``."""
        first, blocks = self.first[text], self.blocks[text]
        place, left, points = (np.zeros(len(text), np.int64) for _ in range(3))
        left += k
        step = 1 << int(blocks.max(initial=0)).bit_length()
        while step := step >> 1:
            there = place + step <= blocks
            node = np.where(there, first + place + step - 1, 0)
            there &= self.units[node] < left
            place += step * there
            left -= self.units[node] * there
            points += self.points[node] * there
        cut = np.flatnonzero(k > 0)
        block = first[cut] + place[cut]
        sizes = self.stops[block] - self.starts[block]
        at = ragged(self.starts[block], sizes)
        ends = self._ends(at, np.repeat(self.lasts[block], sizes))
        rank = np.cumsum(ends)
        begins = np.cumsum(sizes) - sizes
        before = rank[begins] - ends[begins]
        hit = np.searchsorted(rank, before + left[cut], "left")
        seen = np.concatenate([[0], np.cumsum(self.data[at] & 0xC0 != 0x80)])
        out_bytes, out_points = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        out_bytes[cut] = at[hit] + 1 - self.offsets[text[cut]]
        out_points[cut] = points[cut] + seen[hit + 1] - seen[begins]
        return out_bytes, out_points


def arranged(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text cut at bytes ``a`` and ``b``, its parts in the order of ``form``."""
    if form == PLAIN:
        return text
    if form == PSM:
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given: its parts hold no marker, so each is found by the first one of its kind."""
    if form == PLAIN:
        return output
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"not in the form {form}")
    one, _, rest = output[len(first):].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == PSM else two + middle + one


def _data(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, memoryview]:
    """(bytes, offsets of the texts in them, the same bytes) of a binary array; null is empty."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]]
    return np.frombuffer(held, np.uint8), at - at[0], held


def _transform(batch: pa.RecordBatch, rate: int, spm_rate: int, with_text: bool) -> pa.RecordBatch:
    data, offsets, held = _data(batch.column("text"))
    h = [batch.column(f"h{i}").to_numpy() for i in range(1, 5)]
    blocks = Blocks(data, offsets)
    texts = [bytes(held[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    marked = np.array([any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts], bool)
    plain = (blocks.n == 0) | marked | (h[2] % 100 >= rate)
    x, y = h[0] % (blocks.n + 1), h[1] % (blocks.n + 1)
    cut = np.flatnonzero(~plain)
    at, points = np.zeros((2, len(texts)), np.int64), np.zeros((2, len(texts)), np.int64)
    for i, k in enumerate((np.minimum(x, y), np.maximum(x, y))):
        at[i, cut], points[i, cut] = blocks.borders(cut, k[cut])
    forms = [PLAIN if p else SPM if s else PSM for p, s in zip(plain.tolist(), (h[3] % 100 < spm_rate).tolist())]
    outputs = [arranged(t, f, a, b) for t, f, a, b in zip(texts, forms, *at.tolist())]
    columns = {"n": pa.array(blocks.n, pa.int64()), "form": pa.array(forms, pa.string()),
               "prefix_chars": pa.array(points[0], pa.int64(), mask=plain),
               "middle_chars": pa.array(points[1] - points[0], pa.int64(), mask=plain)}
    if with_text:
        columns["output"] = pa.array(outputs, pa.binary()).cast(pa.string())
    else:
        columns["output_sha256"] = pa.array([hashlib.sha256(o).hexdigest() for o in outputs], pa.string())
        columns["restored_sha256"] = pa.array(
            [hashlib.sha256(restored(o, f)).hexdigest() for o, f in zip(outputs, forms)], pa.string())
    return pa.RecordBatch.from_pydict({"doc": batch.column("doc"), **columns})


def fill_in_middle(docs: DataFrame, *, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   with_text: bool = True) -> DataFrame:
    """``doc`` (the whole row), ``n, form, prefix_chars, middle_chars`` and ``output``, or its digests without the text.

    The cuts and the form are drawn from a hash of ``seed`` and ``doc_id`` (a null id counts as an empty one), so rows that
    share an id are cut alike as far as their units go, and nothing depends on partitions. A null or empty text, or one that
    holds a marker, stays ``plain``. A text of any length is counted some megabytes at a time. Input columns are only seen
    through ``doc``, so their names cannot clash; an empty table stays empty.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*docs.columns if with_text else [c for c in docs.columns if c != "text"]).alias("doc"),
                       F.col("text").cast("binary").alias("text"), digest.alias("d"))
    rows = rows.select("doc", "text", *[F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
                                        for i in range(4)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield _transform(part, rate, spm_rate, with_text)

    texts = ["output"] if with_text else ["output_sha256", "restored_sha256"]
    made = [T.StructField(n, t) for n, t in [*_FIELDS, *[(c, T.StringType()) for c in texts]]]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *made]))


def fim_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` and the digests of the output and of the text rebuilt from it."""
    found = fill_in_middle(docs.select("doc_id", "text"), with_text=False)
    return found.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
