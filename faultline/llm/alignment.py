"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together in the corpus.

Both token streams of a slice of texts are given by the byte offsets where their tokens end. Merging the two sorted lists
walks a path through a grid; diagonal binary searches cut the path into pieces of equal work, which are walked side by side
as array operations. A piece emits the overlaps of A and B tokens on its way and marks where both end; groups that cross a
border of pieces are stitched by running counts of these marks.

A text is encoded in segments that start with a single space: neither vocabulary joins anything across such a space, so
recurring segments are encoded once per process.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import SLICE_BYTES, ragged, slices
from faultline.llm.tokens import vocabulary
from faultline.session import fresh_dir

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Work of one piece of the merge path.
PIECE = 256
#: Text whose id pairs are counted together before they are sent to the shuffle.
BLOCK_BYTES = 8 << 20
_SPACE = 0x20
#: First bytes of characters that are surely no white space; a space before one of them may start a segment.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0xC3:0xE1] = _SOLID[0xE4:0xF5] = True
_B_BITS = 16
_DIGITS = 6


def merge_path(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each equal-work piece of the merge of two sorted lists starts: (items of a, items of b) before it, and the ends.

    Of equal items that of ``a`` comes first.
    """
    diagonal = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low, diagonal - low
        middle = (low[open_] + high[open_]) // 2
        before = a[middle] <= b[diagonal[open_] - 1 - middle]
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]


def walk(a: np.ndarray, b: np.ndarray, overlaps: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Tokens of two streams that end at ``a`` and ``b`` bytes: (for each A token the B token that ends with it or -1, overlaps).

    All pieces take their next step together. The overlaps, (A tokens, B tokens) that share a byte, are listed step by step.
    """
    mate = np.full(len(a), -1, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if not len(a) or not len(b):
        return mate, found
    at, bt = merge_path(a, b, PIECE)
    i, j, a_stop, b_stop = at[:-1].copy(), bt[:-1].copy(), at[1:], bt[1:]
    for _ in range(PIECE):
        x, y = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        take = (i < a_stop) & ((j >= b_stop) | (x <= y))
        both = take & (x == y) & (j < len(b))
        mate[i[both]] = j[both]
        if overlaps:
            step = take | (j < b_stop)
            live = np.flatnonzero(step & (i < len(a)) & (j < len(b)))
            p, q = i[live], j[live]
            start = np.maximum(np.where(p > 0, a[p - 1], 0), np.where(q > 0, b[q - 1], 0))
            real = start < np.minimum(a[p], b[q])
            found.append((p[real], q[real]))
        j += ~take & (j < b_stop)
        i += take
    return mate, found


class Vocabularies:
    """Both vocabularies: ids of segments, and the bytes that an id stands for."""

    def __init__(self, a_file: str, b_file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a_path, b_path = (f if "/" in f else vocabulary(f) for f in (a_file, b_file))
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        names = self.a.get_vocab()
        a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            a_bytes[i] = bytes(letter[c] for c in name) if all(c in letter for c in name) else name.encode()
        b_bytes = []
        for i in range(self.b.get_piece_size()):
            name = self.b.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-F]{2})>", name) if self.b.is_byte(i) else None
            b_bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode())
        self.bytes_of = [pa.array(x, pa.binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (a_bytes, b_bytes)]

    def encode(self, segments: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B (ids of all segments one after the other, ids of each); a segment starts with a space."""
        texts = [s.decode("utf-8", "replace") for s in segments]
        both = ([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                self.b.encode([t[1:] for t in texts], num_threads=1))
        return [(np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids], np.int64)) for ids in both]

    def exact(self, segments: list[bytes], encoded: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Whether both kinds of tokens of each segment spell its bytes."""
        wanted, good = b"".join(segments), np.ones(len(segments), bool)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        for table, sizes, (ids, counts) in zip(self.bytes_of, self.sizes, encoded):
            parts, ends = table.take(pa.array(ids)), np.cumsum(counts)
            sums = np.concatenate([[0], np.cumsum(sizes[ids])])
            if len(ids) and parts.buffers()[2].slice(0, int(sums[-1])).equals(pa.py_buffer(wanted)):
                good &= sums[ends] - sums[ends - counts] == lengths
            else:
                good &= [b"".join(parts.slice(e - n, n).to_pylist()) == s
                         for s, e, n in zip(segments, ends.tolist(), counts.tolist())]
        return good


class Aligner:
    """Aligns texts; keeps the tokens of segments, and of a full store those that came up again."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE, limit: int = 300_000) -> None:
        self.words = Vocabularies(a_file, b_file)
        self.limit = limit
        most = max(map(len, self.words.sizes))
        digits = np.zeros((most, _DIGITS), np.uint8)
        for i in range(most):
            digits[i, :len(str(i))] = list(str(i).encode())
        self.digits, self.n_digits = digits, (digits > 0).sum(1)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.good = np.zeros(0, bool)
        self.again = np.zeros(0, bool)
        self.pools = [np.zeros(0, np.int32)] * 2
        self.ends = [np.zeros(1, np.int64)] * 2

    def _add(self, segments: list[bytes], good: np.ndarray, encoded: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.index.update(zip(segments, range(len(self.good), len(self.good) + len(segments))))
        self.good = np.concatenate([self.good, good])
        self.again = np.concatenate([self.again, np.zeros(len(segments), bool)])
        for k, (ids, counts) in enumerate(encoded):
            self.ends[k] = np.concatenate([self.ends[k], len(self.pools[k]) + np.cumsum(counts)])
            self.pools[k] = np.concatenate([self.pools[k], ids])

    def _taken(self, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.ends[k][at + 1] - self.ends[k][at]
        return self.pools[k][ragged(self.ends[k][at], counts)], counts

    def _places(self, segments: list[bytes]) -> np.ndarray:
        if len(self.index) > self.limit:
            kept, names = np.flatnonzero(self.again), list(self.index)
            kept = kept if len(kept) <= self.limit * 2 // 3 else kept[:0]
            rest = [names[i] for i in kept.tolist()], self.good[kept], [self._taken(k, kept) for k in (0, 1)]
            self._clear()
            self._add(*rest)
        known, new = len(self.index), [s for s in segments if s not in self.index]
        if new:
            encoded = self.words.encode(new)
            self._add(new, self.words.exact(new, encoded), encoded)
        at = np.fromiter(map(self.index.__getitem__, segments), np.int64, len(segments))
        self.again[at[at < known]] = True
        return at

    def _cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Sorted places where segments start: those of the texts, and single spaces before a solid character."""
        spaces = data == _SPACE
        cut = np.zeros(len(data), bool)
        cut[1:-1] = spaces[1:-1] & ~spaces[:-2] & _SOLID[data[2:]]
        cut[starts] = True
        return np.flatnonzero(cut)

    def align(self, texts: pa.Array) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
        """(A tokens, B tokens and groups of every text, its groups spelled out, the id pairs that end the groups).

        ``texts``: binary; null and empty ones and those that tokens do not spell have none.
        """
        spaced = pc.binary_join_element_wise(pa.scalar(b" "), texts.fill_null(b""), pa.scalar(b""))
        offsets = np.frombuffer(spaced.buffers()[1], np.int32)[spaced.offset:spaced.offset + len(spaced) + 1]
        data = np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        starts = offsets[:-1].astype(np.int64) - offsets[0]
        cuts = self._cuts(data, starts)
        bounds = pa.py_buffer(np.append(cuts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(cuts), [None, bounds, pa.py_buffer(data.tobytes())]).dictionary_encode()
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        text = np.searchsorted(starts, cuts, "right") - 1
        bad = np.bincount(text[~self.good[at]], minlength=len(texts)) > 0
        bad |= np.diff(offsets) <= 1
        at, text = at[~bad[text]], text[~bad[text]]
        ids, ends, counts = [], [], []
        for k in (0, 1):
            own, n = self._taken(k, at)
            ids.append(own)
            ends.append(np.cumsum(self.words.sizes[k][own]))
            counts.append(np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64))
        mate, _ = walk(*ends)
        linked = np.flatnonzero(mate >= 0)
        firsts = np.cumsum(counts[0])
        before = np.concatenate([[0], np.cumsum(mate >= 0)])
        groups = before[firsts] - before[firsts - counts[0]]
        pairs = (ids[0][linked].astype(np.uint32) << np.uint32(_B_BITS)) | ids[1][mate[linked]].astype(np.uint32)
        return [*counts, groups], self._spelled(ids, linked, mate[linked], groups), pairs

    def _spelled(self, ids: list[np.ndarray], a_last: np.ndarray, b_last: np.ndarray, groups: np.ndarray) -> list[bytes]:
        """``a1,a2|b1;a3|b2`` of every text; the tokens of group g end with ``a_last[g]`` and ``b_last[g]``."""
        a_size, b_size = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        ends = np.cumsum(a_size + b_size)  # of the groups, in a row of all tokens, group by group
        total = int(ends[-1]) if len(ends) else 0
        row, mark = np.zeros(total, np.int32), np.full(total, ord(","), np.uint8)
        row[ragged(ends - a_size - b_size, a_size)] = ids[0]
        row[ragged(ends - b_size, b_size)] = ids[1]
        mark[ends - b_size - 1] = ord("|")
        mark[ends - 1] = ord(";")
        letters = self.digits[row]
        letters[np.arange(total), self.n_digits[row]] = mark
        flat = letters.reshape(-1)
        spelled = flat[flat > 0].tobytes()
        upto = np.concatenate([[0], np.cumsum(self.n_digits[row] + 1)])[np.concatenate([[0], ends])]
        last = np.cumsum(groups)
        return [spelled[a:max(a, b - 1)] for a, b in zip(upto[last - groups].tolist(), upto[last].tolist())]

    def parts(self, text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
        """A long text in parts that start where a segment may start; the space before a later part is left out."""
        data = np.frombuffer(text, np.uint8)
        start = 0
        while len(text) - start > most:
            near = start + most
            window = np.flatnonzero((data[near:-1] == _SPACE) & (data[near - 1:-2] != _SPACE) & _SOLID[data[near + 1:]])
            if not len(window):
                break
            yield text[start:near + int(window[0])]
            start = near + int(window[0]) + 1
        yield text[start:]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """The aligner of this process; tasks that follow each other in a process share its segments."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def _aligned(own: Aligner, texts: pa.Array) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """As ``Aligner.align``; a text longer than a slice, which stands alone, is taken in parts."""
    if len(texts) > 1 or texts.nbytes <= 2 * SLICE_BYTES:
        return own.align(texts)
    counts, spelled, pairs = [], [], []
    for part in own.parts(texts[0].as_py()):
        n, words, keys = own.align(pa.array([part], pa.binary()))
        if not n[2][0]:
            return [np.zeros(1, np.int64)] * 3, [b""], pairs[0][:0] if pairs else keys
        counts.append([int(x[0]) for x in n])
        spelled.append(words[0])
        pairs.append(keys)
    return [np.array([sum(x)]) for x in zip(*counts)], [b";".join(spelled)], np.concatenate(pairs)


_ROWS = ("block long, {key}, n_a long, n_b long, n_groups long, {groups}, codes binary, a array<int>, b array<int>, "
         "n array<long>")


def _in_blocks(batches: Iterator[pa.RecordBatch], a_file: str, b_file: str, with_text: bool, most: int) -> Iterator[pa.RecordBatch]:
    """A row per text, its id pairs as codes of its block, and a row per block with the pairs behind the codes."""
    own, task, number = aligner(a_file, b_file), TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        keys = np.concatenate([h[3] for h in held])
        links = np.concatenate([h[1][2] for h in held])
        names, codes, n = np.unique(keys, return_inverse=True, return_counts=True)
        codes = codes.astype("<u4").tobytes()
        ends = np.cumsum(links) * 4
        rows = len(links)
        none = pa.nulls(1, pa.int64())

        def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            values = pa.array(values, kind)
            offsets = pa.array(np.concatenate([np.zeros(rows + 1, np.int32), [len(values)]]).astype(np.int32),
                               mask=np.concatenate([np.ones(rows, bool), [False, False]]))
            return pa.ListArray.from_arrays(offsets, values)

        ids = pa.concat_arrays([h[0] for h in held])
        words = [w for h in held for w in h[2]]
        spelled = words if with_text else [hashlib.sha256(w).hexdigest() if w else "" for w in words]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows + 1, (task << 32) | number)), pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
            *[pa.concat_arrays([pa.array(np.concatenate([h[1][k] for h in held]), pa.int64()), none]) for k in range(3)],
            pa.array([*spelled, None], pa.string()),
            pa.array([*[codes[e - 4 * n_:e] for e, n_ in zip(ends.tolist(), links.tolist())], None], pa.binary()),
            listed((names >> np.uint32(_B_BITS)).astype(np.int32), pa.int32()),
            listed((names & np.uint32((1 << _B_BITS) - 1)).astype(np.int32), pa.int32()), listed(n, pa.int64()),
        ], names=["block", "doc_id", "n_a", "n_b", "n_groups", "groups", "codes", "a", "b", "n"])

    for part in slices(batches, "text"):
        held.append((part.column("doc_id"), *_aligned(own, part.column("text"))))
        size += part.column("text").nbytes
        if size >= most:
            yield block()
            held, size, number = [], 0, number + 1
    if held:
        yield block()


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, *, with_text: bool = False) -> DataFrame:
    """A written table of one row per document with its token counts and groups, and one per block of documents with the
    id pairs that its groups end with and their counts (``a, b, n``; null in rows of documents).

    ``groups`` is spelled out, or its digest. ``codes`` are little-endian 32-bit places in the lists of the block.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    key = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"
    path = fresh_dir(docs.sparkSession, "aligned")
    rows.mapInArrow(lambda batches: _in_blocks(batches, a_file, b_file, with_text, BLOCK_BYTES),
                    _ROWS.format(key=key, groups="groups string")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _pairs(table: DataFrame) -> DataFrame:
    return table.filter("a IS NOT NULL").selectExpr("block", "posexplode(arrays_zip(a, b, n)) AS (at, x)").selectExpr(
        "block", "at", "x.a AS a", "x.b AS b", "x.n AS n")


def pair_counts(table: DataFrame) -> DataFrame:
    """``a, b, total, is_best``: how often tokens of the two ids end together, and whether no A id does so more often with b.

    ``table`` is that of ``aligned``. The most of every B id is broadcast: one row per entry of the vocabulary.
    """
    totals = _pairs(table).groupBy("a", "b").agg(F.sum("n").alias("total"))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), "b").select("a", "b", "total", (F.col("total") == F.col("most")).alias("is_best"))


def _priced(rows: pa.Table, answers: pa.Table) -> pa.Table:
    total, best = np.zeros(answers.num_rows, np.int64), np.zeros(answers.num_rows, np.int64)
    at = answers["at"].to_numpy()
    total[at], best[at] = answers["total"].to_numpy(), answers["is_best"].to_numpy(zero_copy_only=False)
    sums, bests = [], []
    for chunk in rows["codes"].chunks:
        for codes in chunk:
            code = np.frombuffer(codes.as_buffer(), "<u4")
            sums.append(int(total[code].sum()))
            bests.append(int(best[code].sum()))
    return rows.select(["doc_id", "n_a", "n_b", "n_groups", "groups"]).append_column(
        "n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align_tokens(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, *, with_text: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, groups, n_best, count_sum`` of every row.

    ``n_groups`` is also the number of links, A and B tokens that end together: tokens are never empty, so a byte ends one
    of each at most. ``n_best`` counts the links whose id pair is the most frequent one of its B id in the corpus, ties
    included; ``count_sum`` adds up the counts of the links' pairs. ``groups`` is spelled out ``with_text``, else its SHA-256,
    or empty without tokens. Null and empty texts, and texts that the tokens do not spell, have no tokens: zeros. Only
    ``doc_id`` and ``text`` are read; null and repeated ids are rows like any others; very long texts are aligned in parts; an
    empty table stays empty. Id pairs are counted per block of documents before they are sent around, and a block is
    answered with the counts of its own pairs.
    """
    table = aligned(docs, a_file, b_file, with_text=with_text)
    answers = _pairs(table).select(F.col("block").alias("asked"), "at", "a", "b").join(pair_counts(table), ["a", "b"]).select(
        "asked", "at", "total", "is_best")
    rows = table.filter("a IS NULL").drop("a", "b", "n")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(answers.groupBy("asked")).applyInArrow(_priced, schema)
