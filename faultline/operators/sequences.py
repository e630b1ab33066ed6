"""Token sequences per device, batches, resampled vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import ceil_s, epoch_us, floor_s, quoted
from faultline.operators.order import global_rank, length_bucket_batches
from faultline.operators.vocab import next_token_columns
from faultline.session import settle

STEP = 300  # seconds between sequence ends
CELLS = 1_000_000  # numbers of vectors that a task resamples


def window_seconds(width: float) -> int:
    """A width in minutes, whole or fractional, as seconds."""
    return int(width * 60)


def _in_order(value: Column, *order: Column) -> Column:
    rows = F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], value.alias("v")))
    return F.transform(F.array_sort(rows), lambda r: r["v"])


def hopping_sequences(df: DataFrame, key: str = "ip", ts: str = "timestamp", token: str = "log_key",
                      device: str = "device_id", label: str = "label", tie: str = "event_id", width: float = 15,
                      extra: Sequence[str] = ()) -> DataFrame:
    """Per device the ids of [e - width, e], both ends in, for every 5-minute end e after the first bucket.

    The label looks at (e - 5 min, e] only. A device whose events share one bucket yields nothing. An event is sent
    to the few ends it belongs to and grouped by (device, end), so a busy device spreads over its ends. ``extra``
    keys (e.g. a 4-hour slice) keep sequences apart.
    """
    keys = [key, *extra]
    us = epoch_us(df, ts)
    rows = df.select(*map(quoted, keys), us.alias("_us"), F.col(quoted(token)).cast("int").alias("_tok"),
                     F.col(quoted(device)).alias("_dev"), F.col(quoted(label)).cast("int").alias("_lab"),
                     F.col(quoted(tie)).alias("_tie")).filter(F.col("_us").isNotNull())
    bounds = rows.groupBy(*map(quoted, keys)).agg(
        (ceil_s(F.min("_us"), STEP) + STEP).alias("_lo"), ceil_s(F.max("_us"), STEP).alias("_hi"))
    ends = F.sequence(ceil_s(F.col("_us"), STEP), floor_s(F.col("_us") + window_seconds(width) * 1_000_000, STEP),
                      F.lit(STEP).cast("bigint"))
    late = F.col("_us") > (F.col("window_end") - STEP) * 1_000_000
    # grouped before the bounds are joined: events are never partitioned by device alone
    grouped = rows.withColumn("window_end", F.explode(ends)).groupBy(*map(quoted, keys), "window_end").agg(
        _in_order(F.col("_tok"), F.col("_us"), F.col("_tie")).alias("ids"),
        F.min_by("_dev", F.struct("_us", "_tie")).alias("device_id"),
        F.max(F.when(late, F.col("_lab")).otherwise(0)).alias("label"))
    return (grouped.join(bounds, keys).filter(F.col("window_end").between(F.col("_lo"), F.col("_hi")))
            .drop("_lo", "_hi"))


def tumbling_sequences(df: DataFrame, width: float = 15, key: str = "ip", ts: str = "timestamp", token: str = "log_key",
                       device: str = "device_id", label: str = "label", tie: str = "event_id") -> DataFrame:
    """Per device fixed windows closed on the left; the stamp is the latest event, rounded up to the width.

    Windows count from midnight, for widths that divide no day from the midnight before the device's first event.
    """
    w = window_seconds(width)
    rows = df.withColumn("_us", epoch_us(df, ts)).filter(F.col("_us").isNotNull())
    if 86400 % w:
        first = rows.groupBy(quoted(key)).agg((floor_s(F.min("_us"), 86400) * 1_000_000).alias("_origin"))
        # a device is spread over its days again before it is grouped
        rows = rows.join(first, key).repartition(F.col(quoted(key)), floor_s(F.col("_us"), 86400))
        rows = rows.withColumn("_w", floor_s(F.col("_us") - F.col("_origin"), w)).drop("_origin")
    else:
        rows = rows.withColumn("_w", floor_s(F.col("_us"), w))
    return rows.groupBy(quoted(key), "_w").agg(
        _in_order(F.col(quoted(token)).cast("int"), F.col("_us"), F.col(quoted(tie))).alias("ids"),
        ceil_s(F.max("_us"), w).alias("window_end"),
        F.min_by(quoted(device), F.struct("_us", quoted(tie))).alias("device_id"),
        F.max(F.col(quoted(label)).cast("int")).alias("label")).drop("_w")


def fixed_size_sequences(df: DataFrame, size: int, key: str = "ip", ts: str = "timestamp", token: str = "log_key",
                         label: str = "label", tie: str = "event_id") -> DataFrame:
    """Per device chunks of ``size`` ids in time order. Places come from a distributed rank, not one task per device."""
    ranked = global_rank(df.select(*map(quoted, (key, ts, token, label, tie))), [ts, tie], by=[key], name="_r")
    return ranked.groupBy(quoted(key), F.floor(F.col("_r") / size).alias("chunk")).agg(
        _in_order(F.col(quoted(token)).cast("int"), F.col("_r")).alias("ids"),
        F.max(F.col(quoted(label)).cast("int")).alias("label"))


def pad_batch(df: DataFrame, ids: str, row_id: str, device: str, batch: int, percentile: float = 100,
              seq_len: int | None = None, seed: int = 42) -> DataFrame:
    """V9: length-bucketed batches; each is padded to the given percentile of its lengths (SOS included)."""
    rows = df.withColumn("_len", F.size(quoted(ids)) + 1)
    batches = length_bucket_batches(rows, "_len", row_id, batch, seed)
    sizes = batches.groupBy("batch_id").agg(F.floor(F.percentile("_len", percentile / 100)).cast("int").alias("_size"))
    if seq_len is not None:
        sizes = sizes.withColumn("_size", F.least("_size", F.lit(seq_len)))
    out = batches.join(sizes, "batch_id")
    out = out.withColumns(next_token_columns(F.col(quoted(ids)), F.col(quoted(device)).cast("int"), F.col("_size")))
    return out.withColumn("padded_len", F.col("_size")).drop("_size", "_len", "worker", "step")


def segment_mean(df: DataFrame, row_id: str, pos: str, vec: str, slots: int, mask: str | None = None) -> DataFrame:
    """Resample each row's sequence of vectors to ``slots`` positions.

    Longer ones: mean of the unmasked vectors of slot floor(pos * slots / length). Shorter ones: each vector
    floor(slots / length) times, zeros behind. Input is one row per (row_id, pos), output one per (row_id, slot).
    Tasks grow in number with the numbers to be averaged, and one layout serves all steps.
    """
    m = F.lit(slots)
    rows = df.withColumn("_keep", F.col(quoted(mask)).cast("int") if mask else F.lit(1))
    sizes = settle(rows.groupBy(quoted(row_id)).agg(F.count("*").alias("_n"), F.max(F.size(quoted(vec))).alias("_h")))
    cells = sizes.agg(F.sum(F.greatest("_n", m) * F.greatest("_h", F.lit(1)))).first()[0] or 0
    layout = (-(-cells // CELLS) or 1, F.col(quoted(row_id)), F.col("slot"))
    reps = F.greatest(F.floor(m / F.col("_n")), F.lit(1)).cast("int")
    base = rows.join(sizes, row_id)
    long = F.col("_n") > m
    first = F.when(long, F.floor(F.col(quoted(pos)) * m / F.col("_n"))).otherwise(F.col(quoted(pos)) * reps)
    placed = base.withColumn("_first", first.cast("int")).withColumn(
        "slot", F.explode(F.sequence("_first", F.when(long, F.col("_first")).otherwise(F.col("_first") + reps - 1))))
    # spread by slot too: one long sequence is not one task
    dims = placed.repartition(*layout).select(
        quoted(row_id), "slot", "_keep", long.alias("_long"), F.posexplode(quoted(vec)).alias("_d", "_x"))
    weight = F.when(F.col("_long"), F.col("_keep")).otherwise(F.lit(1))
    means = dims.groupBy(quoted(row_id), "slot", "_d").agg(
        F.coalesce(F.try_divide(F.sum(F.col("_x").cast("double") * weight), F.sum(weight)), F.lit(0.0)).alias("_m"))
    vecs = means.groupBy(quoted(row_id), "slot").agg(_in_order(F.col("_m"), F.col("_d")).alias("vec"))
    grid = sizes.select(quoted(row_id), "_h", F.explode(F.sequence(F.lit(0), m - 1)).alias("slot")).repartition(*layout)
    return (grid.join(vecs, [row_id, "slot"], "left")
            .select(quoted(row_id), "slot", F.coalesce("vec", F.array_repeat(F.lit(0.0), F.col("_h"))).alias("vec")))
