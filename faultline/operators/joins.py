"""Labels by time distance, feature joins, look-ups, device sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import ceil_s, epoch_us, floor_s, from_epoch_s, quoted


def with_hit_ahead(df: DataFrame, start: Column, hits: DataFrame, keys: Sequence[str], at: str, length: int,
                   flag: str, closed: bool = True) -> DataFrame:
    """Add ``flag``: is there a hit with start <= hit <= start + length (``closed``) for the same keys?

    Time is cut into bins as long as the interval, so an interval covers the rest of its own bin and the head of
    the next one. The latest hit of the own bin and the earliest hit of the next bin answer the question exactly:
    hits shrink to one row per (keys, bin) before any shuffle, the join is an equi-join, and no pairs are built.
    ``start`` and ``hits[at]`` are integers in the same unit.
    """
    bin_of = F.floor(F.col(at) / length)
    # every hit serves its own bin as "own" and the bin before as "next"
    roles = F.explode(F.array(F.struct(bin_of.alias("b"), F.lit(True).alias("own")),
                              F.struct((bin_of - 1).alias("b"), F.lit(False).alias("own"))))
    table = (hits.filter(F.col(at).isNotNull()).select(*map(quoted, keys), F.col(at), roles.alias("_role"))
             .groupBy(*map(quoted, keys), F.col("_role.b").alias("_bin"))
             .agg(F.max(F.when(F.col("_role.own"), F.col(at))).alias("_last_own"),
                  F.min(F.when(~F.col("_role.own"), F.col(at))).alias("_first_next")))
    end = F.col("_start") + length
    reach = F.col("_first_next") <= end if closed else F.col("_first_next") < end
    out = (df.withColumn("_start", start).withColumn("_bin", F.floor(F.col("_start") / length))
           .join(table, [*keys, "_bin"], "left")
           .withColumn(flag, F.coalesce(F.col("_last_own") >= F.col("_start"), F.lit(False))
                       | F.coalesce(reach, F.lit(False))))
    return out.select(*[quoted(c) for c in df.columns], flag)


def label_future_windows(windows: DataFrame, incidents: DataFrame, key: str = "ip_address",
                         end: str = "window_5min_end", time: str = "time", gap: int = 300, horizon: int = 1200,
                         grid: int | None = None, dedup: bool = True) -> DataFrame:
    """Label 1 when an incident of the device falls in [end + gap, end + horizon], both ends in.

    A window whose only incidents lie in [end, end + gap) is removed; all others get 0.

    Windows may end anywhere. ``grid`` says that all ends are multiples of that many seconds, and a window that breaks
    this fails the query: an incident then names the few ends it can reach; these shrink to one row per (device, end) and
    join on the window key, so windows that are already grouped by that key do not move again.
    """
    if grid:
        hit = epoch_us(incidents, time)
        reach = (incidents.select(F.col(quoted(key)), hit.alias("_hit")).filter(F.col("_hit").isNotNull())
                 .withColumn("_e", F.explode(F.sequence(
                     ceil_s(F.col("_hit") - horizon * 1_000_000, grid), floor_s(F.col("_hit"), grid),
                     F.lit(grid).cast("bigint"))))
                 .groupBy(quoted(key), "_e")
                 .agg(F.max(F.col("_hit") >= (F.col("_e") + gap) * 1_000_000).alias("_far")))
        side = reach.select(F.col(quoted(key)), from_epoch_s(windows, end, F.col("_e")).alias(end), "_far")
        off = F.coalesce(F.pmod(epoch_us(windows, end), F.lit(grid * 1_000_000)) != 0, F.lit(False))
        broken = F.raise_error(F.lit(f"a window does not end on the {grid} s grid")).cast("boolean")
        out = (windows.join(side, [key, end], "left")
               .filter(F.when(off, broken).otherwise(F.col("_far").isNull() | F.col("_far")))
               .withColumn("label", F.coalesce(F.col("_far").cast("int"), F.lit(0))).drop("_far"))
        out = out.select(*map(quoted, windows.columns), "label")
    else:
        hits = incidents.select(F.col(quoted(key)), epoch_us(incidents, time).alias("_hit"))
        stop = epoch_us(windows, end)
        out = with_hit_ahead(windows, stop, hits, [key], "_hit", gap * 1_000_000, "_near", closed=False)
        out = with_hit_ahead(out, stop + gap * 1_000_000, hits, [key], "_hit", (horizon - gap) * 1_000_000, "_far")
        out = (out.filter(F.col("_far") | ~F.col("_near"))
               .withColumn("label", F.col("_far").cast("int")).drop("_near", "_far"))
    return out.distinct() if dedup else out


def label_asof(events: DataFrame, incidents: DataFrame, key: str = "ip", ts: str = "timestamp", time: str = "time",
               lead: int = 300, tolerance: int = 900) -> DataFrame:
    """Forward as-of label: 1 when the nearest incident at or after ts + lead is at most ``tolerance`` s later.

    The nearest one is within reach exactly when any is, so the existence form gives the same label.
    """
    hits = incidents.select(F.col(quoted(key)), epoch_us(incidents, time).alias("_hit"))
    out = with_hit_ahead(events, epoch_us(events, ts) + lead * 1_000_000, hits, [key], "_hit",
                         tolerance * 1_000_000, "_near")
    return out.withColumn("label", F.col("_near").cast("int")).drop("_near")


def attach_features(base: DataFrame, feats: DataFrame, on: Sequence[str] = ("ip_address", "window_5min_end")) -> DataFrame:
    """Left join of feature columns on the window key; AQE picks the join and splits skewed keys."""
    return base.join(feats, list(on), "left")


def map_through(df: DataFrame, col: str, mapping: DataFrame) -> DataFrame:
    """Join a (``col`` -> ...) table made from the distinct values of ``col`` back to every row."""
    return df.join(mapping, col, "left")


def lookup_vocab(df: DataFrame, vocab: DataFrame, col: str, token: str = "token", out: str = "id",
                 unk: int = 1) -> DataFrame:
    """Value -> id, unknown values -> ``unk``. One vocabulary row per value; AQE broadcasts it if it measures small."""
    side = vocab.select(F.col(quoted(token)).alias("_v_token"), F.col("id").alias("_v_id"))
    return (df.join(side, F.col(quoted(col)) == F.col("_v_token"), "left")
            .withColumn(out, F.coalesce(F.col("_v_id"), F.lit(unk))).drop("_v_token", "_v_id"))


def entity_universe(inventory: Sequence[tuple[DataFrame, str]], labels: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Distinct devices of all (table, column) pairs, kept only if labelled when ``labels`` is given."""
    out = None
    for table, col in inventory:
        part = table.select(F.col(quoted(col)).alias("ip_address"))
        out = part if out is None else out.union(part)
    out = out.filter(F.col("ip_address").isNotNull()).distinct()
    if labels is not None:
        out = out.intersect(labels[0].select(F.col(quoted(labels[1])).alias("ip_address")))
    return out
