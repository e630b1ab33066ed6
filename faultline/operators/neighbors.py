"""Exact k nearest neighbours as a distributed join, and minority oversampling on top of it.

Rows go to the cell of their nearest pivot and, in the order of their cells, into blocks of bounded size. A first pass inside
the own block bounds the distance to the k-th neighbour. By the triangle inequality a row then only needs the blocks with a
cell that this bound reaches. Blocks are compared inside tasks: one matrix product finds the few rows that may be near enough,
their distances are then taken exactly, and only the best k per row and block leave a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.operators.order import global_rank
from faultline.operators.vocab import uniform
from faultline.session import settle

BLOCK = 32_768  # rows of one side of a comparison, at most
BLOCK_BYTES = 16 << 20  # and their bytes
LEAST, TILES = 1024, 16  # smaller tables are cut into up to TILES blocks of LEAST rows or more, for all cores to have some
STRIP = 256  # rows compared with a block at a time
PIVOTS = 256  # at most; they are the only rows the driver sees

_PAIR = "id bigint, other bigint, dist double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)


def _near(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, bound: np.ndarray, k: int) -> tuple:
    """(place in ``a``, id, distance) of up to ``k`` nearest rows of ``b`` for every row of ``a``, ties by id.

    ``bound``: distance that is not to be exceeded, NaN for none. The matrix product picks rows only, with room for its rounding.
    """
    sq_a, sq_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    d = np.add.outer(sq_a, sq_b) - 2 * (a @ b.T)
    room = 4e-15 * (a.shape[1] + 8) * (sq_a + sq_b.max())
    d[np.isnan(d)] = np.inf
    d[ia[:, None] == ib] = np.inf  # not its own neighbour
    limit = bound * bound * (1 + 1e-12) + room
    free = np.flatnonzero(np.isnan(bound))
    if len(free):
        limit[free] = np.partition(d[free], min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1] + room[free]
    at, other = np.nonzero(d <= limit[:, None]) if np.isfinite(room).all() else np.indices(d.shape).reshape(2, -1)
    dist = np.concatenate([np.zeros(0), *[np.sqrt(((b[other[i:i + 65536]] - a[at[i:i + 65536]]) ** 2).sum(axis=1))
                                          for i in range(0, len(at), 65536)]])
    ok = np.isfinite(dist) & (ia[at] != ib[other])
    at, other, dist = at[ok], ib[other[ok]], dist[ok]
    order = np.lexsort((other, dist, at))
    at, other, dist = at[order], other[order], dist[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], other[place < k], dist[place < k]


def _best_k(k: int):
    want = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("dist", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return want.empty_table()
        a, b = _matrix(left["vec"]), _matrix(right["vec"])
        ia, ib = left["id"].to_numpy(), right["id"].to_numpy()
        bound = left["bound"].to_numpy().astype(np.float64) if "bound" in left.column_names else np.full(len(a), np.nan)
        found = []
        with np.errstate(invalid="ignore", over="ignore"):
            for i in range(0, len(a), STRIP):
                at, other, dist = _near(a[i:i + STRIP], ia[i:i + STRIP], b, ib, bound[i:i + STRIP], k)
                found.append((ia[i + at], other, dist))
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=want)

    return run


def _top(pairs: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct("dist", "other"))), 1, k)
    return pairs.groupBy("id").agg(best.alias("best"))


def nearest_neighbors(df: DataFrame, row_id: str, vec: str, k: int) -> DataFrame:
    """(id, other, dist, place): the ``k`` nearest other rows by Euclidean distance, ties by id. Exact."""
    rows = df.select(F.col(quoted(row_id)).cast("bigint").alias("id"), F.col(quoted(vec)).cast("array<double>").alias("vec"))
    n = rows.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], _PAIR + ", place int")
    # pivots by hash order: repeatable, and spread like the data
    wanted = max(1, min(PIVOTS, int(n ** 0.5)))
    pivots = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()])

    @F.pandas_udf("array<double>")
    def to_pivots(v):
        import pandas as pd

        m = np.stack(v.to_numpy())
        return pd.Series(list(np.sqrt(np.stack([((m - p) ** 2).sum(axis=1) for p in pivots], axis=1))))

    size = min(BLOCK, max(LEAST, -(-n // TILES)), max(LEAST, BLOCK_BYTES // (8 * max(1, pivots.shape[1]))))
    near = rows.withColumn("_d", to_pivots("vec")).withColumn("_m", F.array_min("_d")).withColumn(
        "cell", F.array_position("_d", F.col("_m")).cast("int") - 1).drop("_d")
    near = global_rank(near, ["cell", "id"], name="_r")
    near = settle(near.withColumn("block", F.floor(F.col("_r") / size).cast("int")).drop("_r"))
    run = _best_k(k)

    # first pass: own block; every block but the last is full
    own = near.select("block", "id", "vec")
    twin = own.select(*[F.col(c).alias(c) for c in own.columns])  # the same rows under fresh column ids
    first = settle(own.groupBy("block").cogroup(twin.groupBy("block")).applyInArrow(run, _PAIR))
    bound = _top(first, k).select("id", F.when(F.size("best") == k, F.element_at("best", -1)["dist"]).alias("bound"))
    radius = near.groupBy("block", "cell").agg(F.max("_m").alias("_rad"))
    cells = radius.agg(F.sort_array(F.collect_list(F.struct("block", "cell", "_rad"))).alias("_cells"))
    # fewer than k in the own block: no bound yet, all blocks are reached
    reach = F.array_distinct(F.transform(F.filter("_cells", lambda c: (c["block"] != F.col("block")) & (
        F.col("bound").isNull() | (F.get(F.col("_d"), c["cell"]) - c["_rad"] <= F.col("bound") * (1 + 1e-9) + 1e-9))),
        lambda c: c["block"]))
    sent = (near.join(bound, "id", "left").withColumn("_d", to_pivots("vec"))
            .crossJoin(F.broadcast(cells))  # one row; a block has a new cell or is the next of its cell
            .select("id", "vec", "bound", F.explode(reach).alias("block")))
    # askers of one block are split too, so that a popular block is many tasks
    parts = near.groupBy().agg(F.ceil(F.count("*") / size).cast("int").alias("_parts"))
    asks = sent.crossJoin(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    answers = own.crossJoin(F.broadcast(parts)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    keys = ["block", "part"]
    pairs = (asks.select(*keys, "id", "vec", "bound").groupBy(*keys)
             .cogroup(answers.select(*[F.col(c).alias(c) for c in (*keys, "id", "vec")]).groupBy(*keys))
             .applyInArrow(run, _PAIR))
    best = _top(first.unionByName(pairs), k)
    return best.select("id", F.posexplode("best").alias("place", "_b")).select(
        "id", F.col("_b.other").alias("other"), F.col("_b.dist").alias("dist"), "place")


def oversample_minority(df: DataFrame, row_id: str, vec: str, label: str = "label", k: int = 5,
                        seed: int = 42) -> DataFrame:
    """new minority rows between a minority row and one of its k nearest, until both classes are equal.

    Returns the vectors of old and new rows (``synthetic`` tells them apart); unchanged with under two minority rows.
    """
    base = df.select(F.col(quoted(row_id)).cast("bigint").alias("id"), F.col(quoted(vec)).cast("array<double>").alias("vec"),
                     F.col(quoted(label)).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in base.groupBy("label").count().collect()}  # one row per class
    out = base.withColumn("synthetic", F.lit(False))
    if len(counts) < 2:
        return out
    minority = min(counts, key=lambda c: (counts[c], c))
    few, need = counts[minority], max(counts.values()) - counts[minority]
    if few < 2 or need == 0:
        return out
    k = min(k, few - 1)
    small = settle(base.filter(F.col("label") == minority).select("id", "vec"))
    near = nearest_neighbors(small, "id", "vec", k).select("id", "other", "place")
    ranked = global_rank(small, ["id"], name="_r")
    draws = (df.sparkSession.range(need).select(
        F.col("id").alias("_j"), F.floor(uniform(seed, F.col("id")) * few).alias("_r"),
        F.floor(uniform(seed + 1, F.col("id")) * k).cast("int").alias("place"),
        uniform(seed + 2, F.col("id")).alias("_u")))
    picked = draws.join(ranked, "_r").join(near, ["id", "place"])
    other = small.select(F.col("id").alias("other"), F.col("vec").alias("_vec"))
    made = picked.join(other, "other").select(
        (-F.col("_j") - 1).alias("id"), F.zip_with("vec", "_vec", lambda a, b: a + (b - a) * F.col("_u")).alias("vec"),
        F.lit(minority).alias("label"), F.lit(True).alias("synthetic"))
    return out.unionByName(made)
