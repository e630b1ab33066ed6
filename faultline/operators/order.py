"""Ranks and running totals over a whole table without a one-task window (G0), and time slices with a halo."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.session import settle

ROWS_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def as_col(key: str | Column) -> Column:
    return F.col(quoted(key)) if isinstance(key, str) else key


def laid_out(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
             keep: Callable[[DataFrame], DataFrame] = settle) -> DataFrame:
    """Range-partition and sort by (by, order), then fix ``_part`` and ``_at`` on shared storage.

    The written copy makes every later read see the same partition bounds and row numbers. Small ranges are put together
    by their size. ``keep`` writes the copy.
    """
    keys = [*[F.col(quoted(b)) for b in by], *[as_col(o) for o in order]]
    numbered = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                .withColumn("_at", F.monotonically_increasing_id()))
    return keep(numbered.withColumn("_part", F.shiftright("_at", ROWS_BITS)))


def global_rank(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (),
                name: str = "rank", keep: Callable[[DataFrame], DataFrame] = settle, few: bool = False) -> DataFrame:
    """Exact 0-based rank in the whole table, or within each ``by`` key however large.

    Give ``order`` a unique last key: ranks are then repeatable, and equal leading keys spread over partitions. With ``few``
    keys of ``by`` the rows are not shuffled a second time.
    """
    rows = laid_out(df, order, by, keep)
    pieces = rows.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition and key, so this window stays small
    starts = pieces.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    starts = starts.withColumnsRenamed({b: f"_k_{i}" for i, b in enumerate(by)}).withColumnRenamed("_part", "_p")
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on = on & F.col(quoted(b)).eqNullSafe(F.col(f"_k_{i}"))
    side = starts if by and not few else F.broadcast(starts)  # one row per partition and key
    ranked = rows.join(side, on).withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_first"))
    return ranked.select(*[quoted(c) for c in df.columns], name)


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Running totals over the whole table: ``sums`` maps new column -> summed column."""
    rows = laid_out(df, order)
    totals = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"),
                            *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums])
    here = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_s_{n}": F.sum(c).over(here) for n, c in sums.items()})
    out = out.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))  # one row per partition
    return out.select(*[quoted(c) for c in df.columns],
                      *[(F.col(f"_o_{n}") + F.col(f"_s_{n}")).alias(n) for n in sums])


def with_halo(df: DataFrame, sec: Column, lookback: int, span: int | None = None) -> DataFrame:
    """Cut time into slices of ``span`` seconds; rows near a slice end are also sent to the slices that look back at them.

    Windows partitioned by (key, ``_slice``) then see every row of the last ``lookback`` seconds, and one busy
    device spreads over many tasks. Keep rows with ``_own`` afterwards.
    """
    span = span or 4 * lookback
    first = F.floor(sec / span)
    return (df.withColumn("_first", first)
            .withColumn("_slice", F.explode(F.sequence(F.col("_first"), F.floor((sec + lookback) / span))))
            .withColumn("_own", F.col("_slice") == F.col("_first")).drop("_first"))


def sort_stable(df: DataFrame, keys: Sequence[str | Column], tie: str) -> DataFrame:
    """O1: total order with an explicit tie-break column."""
    return df.orderBy(*[as_col(k) for k in keys], as_col(tie))


def length_bucket_batches(df: DataFrame, length: str, row_id: str, batch: int, seed: int = 42, epoch: int = 0,
                          world: int = 1, drop_last: bool = False) -> DataFrame:
    """O3: rows of similar length in batches of ``batch``; batches shuffled by seed, then dealt to ``world`` ranks.

    Returns one row per input row and use, with ``batch_id`` (by length), ``slot`` (place of the batch in the
    shuffled list), ``worker`` and ``step``. Padding repeats batches from the start of the list until ``world``
    divides it, as often as needed.
    """
    ranked = global_rank(df, [length, row_id], name="_r")
    ranked = ranked.withColumn("batch_id", F.floor(F.col("_r") / batch)).drop("_r")
    sizes = ranked.groupBy("batch_id").agg(F.count("*").alias("_n"))
    if drop_last:
        sizes = sizes.filter(F.col("_n") == batch)
    sizes = sizes.withColumn("_h", F.xxhash64(F.lit(seed + epoch), F.col("batch_id")))
    slots = global_rank(sizes.select("batch_id", "_h"), ["_h", "batch_id"], name="slot")
    total = slots.agg(F.count("*").alias("_total"))
    padded = F.ceil(F.col("_total") / world) * world
    uses = (slots.crossJoin(F.broadcast(total))  # one-row side
            .filter(F.col("_total") > 0)
            .withColumn("slot", F.explode(F.sequence(F.col("slot"), padded - 1, F.col("_total"))))
            .select("batch_id", "slot", F.pmod("slot", F.lit(world)).alias("worker"),
                    F.floor(F.col("slot") / world).alias("step")))
    return ranked.join(uses, "batch_id")


def top_by(df: DataFrame, keys: Sequence[Column], k: int) -> DataFrame:
    """O2: the ``k`` first rows in the order of ``keys``."""
    return df.orderBy(*keys).limit(k)
