"""Window rows, pivots, merges, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted
from faultline.operators.order import running_sums


def last_row_per_window(df: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """A1: per key the row with the latest ``ts``; equal times fall back to the largest ``tie`` values.

    ``max_by`` combines on the map side, so a busy key never travels as rows. Where ``ts`` and ``tie`` are the whole row,
    it is its own order and travels once.
    """
    rest = [c for c in df.columns if c not in keys]
    newest = F.struct(*[F.col(quoted(c)) for c in [ts, *tie]]) if tie else F.col(quoted(ts))
    if tie and {ts, *tie} == set(rest):
        picked = df.groupBy(*map(quoted, keys)).agg(F.max(newest).alias("_row"))
        return picked.select(*map(quoted, keys), *[F.col(f"_row.{quoted(c)}").alias(c) for c in rest])
    picked = df.groupBy(*map(quoted, keys)).agg(
        F.max_by(F.struct(*[F.col(quoted(c)) for c in rest]), newest).alias("_row"))
    return picked.select(*map(quoted, keys), "_row.*")


MAX_COMPONENTS = 2000  # each becomes columns


def component_names(df: DataFrame, component: str, most: int = MAX_COMPONENTS) -> list[str]:
    """The distinct components in order; an error when there are more than ``most``."""
    found = distinct_set(df, component).orderBy(quoted(component)).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values in {component}")
    return [r[0] for r in found]


def pivot_components(df: DataFrame, keys: Sequence[str], component: str, values: Sequence[str],
                     names: Sequence[str] | None = None, tie: str = "job_id") -> DataFrame:
    """A2: one column per (component, value). Of several polls the one with the smallest ``tie`` counts.

    The components are looked up in one job. Passing ``names`` saves that job; a component of the data that is not
    listed then fails the query. Rows without a component are left out. Where text must be sorted to be combined, the
    values of a component are one struct, so that a sorted row has two columns a component and not two a value.
    """
    if names is None:
        names = component_names(df, component)
    c = F.col(quoted(component))
    unlisted = F.raise_error(F.concat(F.lit("component not listed: "), c.cast("string"))).cast(df.schema[component].dataType)
    df = df.filter(c.isNotNull()).withColumn(component, F.when(c.isin(list(names)), c).otherwise(unlisted))
    by_name = df.groupBy(*map(quoted, keys)).pivot(component, list(names))
    if len(values) == 1 or all(isinstance(df.schema[c].dataType, T.NumericType) for c in (*values, tie)):
        return by_name.agg(*[F.min_by(F.col(quoted(v)), F.col(quoted(tie))).alias(v) for v in values])
    wide = by_name.agg(F.min_by(F.struct(*[F.col(quoted(v)) for v in values]), F.col(quoted(tie))))
    return wide.select(*map(quoted, keys), *[F.col(f"{quoted(c)}.{quoted(v)}").alias(f"{c}_{v}")
                                             for c in wide.columns[len(keys):] for v in values])


def first_non_null_merge(dfs: Sequence[DataFrame], keys: Sequence[str], single: bool = False,
                         tasks: int | None = None) -> DataFrame:
    """A4: union of feature frames, per key and column the first non-NULL value, in one aggregation.

    ``single`` promises that no frame has two rows of one key. A row then travels as one value beside its keys, dealt to ``tasks``
    if given: of many columns most are those of other frames.
    """
    if single:
        rows = [d.select(*map(quoted, keys), F.struct(*[F.col(quoted(c)) for c in d.columns if c not in keys]).alias(f"_f{i}"))
                for i, d in enumerate(dfs)]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        union = union.repartition(tasks, *map(quoted, keys)) if tasks else union
        merged = union.groupBy(*map(quoted, keys)).agg(*[F.first(f"_f{i}", True).alias(f"_f{i}") for i in range(len(dfs))])
        names = dict.fromkeys(c for d in dfs for c in d.columns if c not in keys)
        return merged.select(*map(quoted, keys), *[F.coalesce(*[
            F.col(f"_f{i}.{quoted(c)}") for i, d in enumerate(dfs) if c in d.columns]).alias(c) for c in names])
    tagged = [d.withColumn("_src", F.lit(i)) for i, d in enumerate(dfs)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in union.columns if c not in (*keys, "_src")]
    # earliest frame with a value wins: repeatable, and plain min() aggregates on the map side
    picks = [F.min_by(F.col(quoted(c)), F.when(F.col(quoted(c)).isNotNull(), F.col("_src"))).alias(c) for c in cols]
    return union.groupBy(*map(quoted, keys)).agg(*picks)


def combine_messages(df: DataFrame, keys: Sequence[str], ts: str, msg: str, out: str = "combined_message") -> DataFrame:
    """A5: the messages of a window in (time, text) order, one space between, lower case.

    The text of a window is one value of the result, so a group is as large as its output cell and no larger.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(quoted(ts)).alias("t"), F.col(quoted(msg)).alias("m"))))
    text = F.lower(F.concat_ws(" ", F.transform(rows, lambda r: r["m"])))
    return df.groupBy(*map(quoted, keys)).agg(text.alias(out))


def distinct_set(df: DataFrame, col: str) -> DataFrame:
    """The set of non-NULL values, as a table."""
    return df.select(quoted(col)).filter(F.col(quoted(col)).isNotNull()).distinct()


def time_range(df: DataFrame, col: str) -> DataFrame:
    """First and last time."""
    return df.agg(F.min(quoted(col)).alias("min_ts"), F.max(quoted(col)).alias("max_ts"))


def split_stats(df: DataFrame, label: str = "label", entity: str = "ip_address") -> DataFrame:
    """Rows, positives, positive rate (0 when empty), devices."""
    pos = F.coalesce(F.sum((F.col(quoted(label)) == 1).cast("bigint")), F.lit(0))
    return df.agg(F.count("*").alias("rows"), pos.alias("positives"),
                  F.coalesce(F.try_divide(pos, F.count("*")), F.lit(0.0)).alias("positive_rate"),
                  F.count_distinct(quoted(entity)).alias("devices"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight N / (2 n_c) for the classes 0 and 1, all ones on empty input; plus negatives / positives."""
    c = F.col(quoted(label))
    one = df.agg(F.count_if(c == 0).alias("n0"), F.count_if(c == 1).alias("n1"))
    n = F.col("n0") + F.col("n1")

    def weight(k: Column) -> Column:
        return F.when(n == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(n, 2 * k), F.lit(float("inf"))))

    return one.select(F.col("n0"), F.col("n1"), weight(F.col("n0")).alias("weight_0"),
                      weight(F.col("n1")).alias("weight_1"),
                      F.try_divide(F.col("n0"), F.col("n1")).alias("neg_pos_ratio"))


def positive_entities(df: DataFrame, scope: Sequence[str], label: str = "label") -> DataFrame:
    """A10: keep rows of scopes (device, or device and day) with at least one positive label."""
    hot = df.filter(F.col(quoted(label)) == 1).select(*map(quoted, scope)).distinct()
    return df.join(hot, list(scope), "left_semi")


def trailing_active_entities(incidents: DataFrame, ip: str, time: str, days: int = 7) -> DataFrame:
    """Per day the devices with an incident on that day or one of the ``days`` - 1 days before.

    The end of a day is inclusive: an incident at exactly midnight also counts for the day that ends there.
    """
    t = F.col(quoted(time))
    day = F.to_date(t)
    midnight = t == day.cast(incidents.schema[time].dataType)
    seen = incidents.select(F.col(quoted(ip)).alias("ip_address"), day.alias("_d"),
                            F.date_sub(day, F.when(midnight, 1).otherwise(0)).alias("_from")).distinct()
    span = F.sequence(F.col("_from"), F.date_add("_d", days - 1))
    last = incidents.agg(F.max(day).alias("_last"))
    return (seen.crossJoin(F.broadcast(last))  # one-row side
            .select("ip_address", F.explode(span).alias("date"), "_last")
            .filter(F.col("date") <= F.col("_last")).select("ip_address", "date").distinct())


def keep_active(df: DataFrame, active: DataFrame, ip: str, ts: str) -> DataFrame:
    """Rows of devices active on the day of the row."""
    side = active.select(F.col("ip_address").alias("_ip"), F.col("date").alias("_d"))
    return df.join(side, (F.col(quoted(ip)) == F.col("_ip")) & (F.to_date(quoted(ts)) == F.col("_d")), "left_semi")


def describe_values(df: DataFrame, col: str, tie: Sequence[str], bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """(summary row, density histogram) of a value column.

    Quartiles interpolate between exact ranks, found by running counts over the distinct values; ``tie`` is not needed any
    more and kept for callers.
    """
    v = df.select(F.col(quoted(col)).cast("double").alias("v")).filter(F.col("v").isNotNull())
    basic = v.agg(F.count("*").alias("n"), F.sum(F.abs("v")).alias("l1_norm"), F.min("v").alias("min"),
                  F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    counts = running_sums(v.groupBy("v").agg(F.count("*").alias("_c")), ["v"], {"_upto": "_c"})
    joined = counts.crossJoin(F.broadcast(basic.select("n")))  # one-row side
    picks = []

    def holds(rank: Column) -> Column:
        return (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)

    for name, p in marks.items():
        at = (F.col("n") - 1) * F.lit(p)
        lo, frac = F.floor(at), at - F.floor(at)
        weight = F.when(holds(lo), 1 - frac).otherwise(0.0) + F.when(holds(lo + 1), frac).otherwise(0.0)
        picks.append(F.sum(F.when(weight > 0, F.col("v") * weight)).alias(name))
    summary = basic.crossJoin(F.broadcast(joined.agg(*picks)))  # two one-row sides
    width = (F.col("max") - F.col("min")) / bins
    slot = F.least(F.floor((F.col("v") - F.col("min")) / F.col("_w")), F.lit(bins - 1))
    hist = (v.crossJoin(F.broadcast(basic.select("n", "min", "max").withColumn("_w", width)))
            .withColumn("bin", F.when(F.col("_w") > 0, slot).otherwise(F.lit(0)).cast("int"))
            .groupBy("bin", "n", "min", "_w").agg(F.count("*").alias("obs"))
            .select("bin", "obs", (F.col("min") + F.col("bin") * F.col("_w")).alias("left_edge"),
                    F.try_divide(F.col("obs"), F.col("n") * F.col("_w")).alias("density")))
    return summary, hist
