"""Packing token sequences by patterns of lengths.

Only the histogram of piece lengths, at most ``capacity`` counts, comes to the driver. There, patterns of up to four
lengths that fill a sequence are enumerated on a coarse grid, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left is packed by best fit, longest first, into the gaps and into new
sequences; all of this handles equal sequences as one entry with a count. The resulting slots say which ranks of a length
go where, so every piece finds its place from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from faultline.llm.common import slices
from faultline.llm.tokens import encoder as encoder_of
from faultline.session import fresh_dir

CAPACITY = 4096
#: Cells of the coarse grid of lengths.
GRID = 128
#: Documents in a pattern, at most.
DEPTH = 4

_PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, rank long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document, cut where it is longer than ``capacity``.

    Also ``part`` and ``rank``: the place among the pieces of that length made by one task, so the result has to be
    written before ``rank`` is used. Null texts count as empty and have the end id alone; rows that repeat are packed
    each; a null ``doc_id`` stays null. Columns other than ``doc_id`` and ``text`` are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, made = encoder_of(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            ids, counts = encoder.encode(batch.column("text"))
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(counts)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = ((np.cumsum(counts) - counts)[row] + start).tolist()
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at, length.tolist())]
            order = np.argsort(length, kind="stable")
            run = length[order]
            first = np.searchsorted(run, run)
            rank = np.empty(len(row), np.int64)
            rank[order] = made[run] + np.arange(len(run)) - first
            made += np.bincount(length, minlength=capacity + 1)
            columns = [pa.array(np.full(len(row), part, np.int32)), batch.column("doc_id").take(pa.array(row)),
                       pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                       pa.array(rank)]
            names = ["part", "doc_id", "piece", "start", "length", "ids_crc32", "rank"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, _PIECES + (", ids array<int>" if with_ids else ""))


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimises |a x - b| over x >= 0 by an active set."""
    x, active, ab = np.zeros(a.shape[1]), [], a.T @ b
    for _ in range(3 * a.shape[0]):
        gain = ab - a.T @ (a @ x)
        gain[active] = 0
        j = int(np.argmax(gain))
        if gain[j] <= 1e-7 * max(1.0, float(np.abs(ab).max())):
            break
        active.append(j)
        while True:
            part = a[:, active]
            gram = part.T @ part
            z = np.linalg.solve(gram + 1e-9 * np.trace(gram) / len(active) * np.eye(len(active)), ab[active])
            bad = z <= 1e-12
            if not bad.any():
                break
            now = x[active]
            step = np.min(now[bad] / np.maximum(now[bad] - z[bad], 1e-300))
            x[active] = now + step * (z - now)
            x[[j for j in active if x[j] <= 1e-12]] = 0
            active = [j for j in active if x[j] > 0]
        x[active] = z
    return x


def patterns(present: np.ndarray, total: int) -> np.ndarray:
    """Rows of ``DEPTH`` grid cells, zero-filled and descending, from ``present`` that add up to ``total`` or one less."""
    have = np.zeros(total + 1, bool)
    have[present] = True
    cells = np.concatenate([[0], present])
    a, b, c = (x.ravel() for x in np.meshgrid(cells, cells, cells, indexing="ij"))
    keep = (a >= b) & (b >= c) & (a > 0)
    a, b, c = a[keep], b[keep], c[keep]
    out = []
    for want in (total, total - 1):
        d = want - a - b - c
        ok = (d == 0) | ((d > 0) & (d <= c) & have[np.clip(d, 0, total)])
        out.append(np.stack([a[ok], b[ok], c[ok], d[ok]], axis=1))
    return np.concatenate(out)


def _by_patterns(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences made of fitted patterns, as (lengths, how many); takes what it uses out of ``left``.

    All lengths of a pattern but the last are the longest left in their cells; the last is the longest that still fits.
    A pattern ends early when that leaves a cell or more empty.
    """
    width = -(-capacity // GRID)
    total = capacity // width
    cell = {n: min(max(1, round(n / width)), total) for n in left}
    found = np.zeros(total + 1)
    for n, count in left.items():
        found[cell[n]] += count
    present = np.flatnonzero(found)
    rows = patterns(present, total) if len(present) else np.zeros((0, DEPTH), int)
    if not len(rows):
        return []
    a = np.stack([(rows == p).sum(axis=1) for p in present]).astype(float)
    weight = np.sqrt(present / total)[:, None]
    x = nnls(a * weight, found[present] * weight[:, 0])
    queues = {int(p): sorted((n for n in left if cell[n] == p), reverse=True) for p in present}
    lengths = sorted(left)
    made = []
    for k in np.argsort(-x, kind="stable"):
        repeats = int(round(x[k]))
        if not repeats:
            break
        parts = [int(p) for p in rows[k] if p][:-1]
        while repeats:
            taken: list[int] = []
            for p in parts:
                taken.append(next((n for n in queues[p] if left[n] > taken.count(n)), capacity + 1))
            gap = capacity - sum(taken)
            at = bisect_right(lengths, gap) - 1
            while at >= 0 and left[lengths[at]] <= taken.count(lengths[at]):
                at -= 1
            if at < 0 or gap - lengths[at] >= width:
                break
            taken.append(lengths[at])
            times = min(repeats, *(left[n] // taken.count(n) for n in taken))
            for n in set(taken):
                left[n] -= times * taken.count(n)
                if not left[n]:
                    lengths.remove(n)
                    queues[cell[n]].remove(n)
            made.append((tuple(taken), times))
            repeats -= times
    return made


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many of them); every piece of the histogram is in exactly one."""
    left = {n: c for n, c in histogram.items() if c}
    full = left.pop(capacity, 0)
    made = _by_patterns(left, capacity)
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], times: int) -> None:
        space = capacity - sum(lengths)
        if space not in room:
            room[space] = []
            insort(spaces, space)
        room[space].append((lengths, times))

    for lengths, times in made:
        put(lengths, times)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            at = bisect_left(spaces, n)
            if at == len(spaces):
                each = min(capacity // n, count)
                put((n,) * each, count // each)
                count %= each
                continue
            space = spaces[at]
            lengths, times = room[space].pop()
            if not room[space]:
                del room[space]
                spaces.pop(at)
            each = min(space // n, max(1, count // times))
            used = min(times, count // each)
            put(lengths + (n,) * each, used)
            if used < times:
                put(lengths, times - used)
            count -= used * each
    out = [x for space in sorted(room) for x in room[space]]
    return ([((capacity,), full)] if full else []) + out


def slots(made: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset) sorted by length and rank; ranks of a length have no gaps."""
    rows, given, sequence = [], {}, 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            rows.append((n, given.get(n, 0), sequence, offset))
            given[n] = given.get(n, 0) + times
            offset += n
        sequence += times
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece of ``docs``."""
    spark = docs.sparkSession
    path = fresh_dir(spark, "pieces")
    cut_pieces(docs, vocabulary, capacity, with_ids).write.parquet(path)
    cut = spark.read.parquet(path)
    per_task = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = (cut.join(per_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
              .withColumn("rank", F.col("before") + F.col("rank")).drop("part", "before"))
    extra = ["ids"] if with_ids else []

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = 1 << 44
        keys = table[:, 0] * high + table[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() * high + rank, side="right") - 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3]),
                 *(batch.column(c) for c in extra)], names=[*names, "sequence_id", "offset", *extra])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, "
                             "offset long" + (", ids array<int>" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids``: the packed sequences themselves, each a group of at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
