"""Rolling features on closed time ranges.

Frames look back a fixed number of seconds, so time is cut into slices with a halo (:func:`with_halo`) and each
slice is one window partition: a device that holds a third of all rows still spreads over the cluster. Numbers are first added up per second on the map
side, so a slice has at most one row per second however busy the device is. A sum over a moving frame is the difference of
two sums from the start of the slice, which grow row by row: the work is linear in the rows, however long the frame.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.functions.clock import quoted
from faultline.operators.order import with_halo


PER_ONE = 10_000.0  # units that means are exact in
UNITS_BELOW = 1e6  # so that the units of 9e8 rows of a slice fit 64 bits


def _range(keys: Sequence[str], sec: str, lo: int, hi: int = 0) -> Window:
    return Window.partitionBy(*map(quoted, keys), "_slice").orderBy(sec).rangeBetween(lo, hi)


def _upto(total: Column, keys: Sequence[str], sec: str, hi: int) -> Column:
    """Sum from the start of the slice to ``hi`` seconds from here; 0 where nothing is that early."""
    return F.coalesce(F.sum(total).over(_range(keys, sec, Window.unboundedPreceding, hi)), F.lit(0))


def _moving(total: Column, keys: Sequence[str], sec: str, lo: int, hi: int = 0) -> Column:
    """Sum over [t + lo, t + hi]; for doubles, rounding is that of the slice's running sum."""
    return _upto(total, keys, sec, hi) - _upto(total, keys, sec, lo - 1)


def _per_second(df: DataFrame, keys: Sequence[str], sec: str, aggs: Sequence[Column], lookback: int) -> DataFrame:
    return with_halo(df.groupBy(*map(quoted, keys), sec).agg(*aggs), F.col(sec), lookback)


def _mean(units: Column, others: Column, n: Column, off: Column) -> Column:
    """Mean of ``n`` values from their units, unless ``others`` of them are no whole units: then from the slice's mean."""
    return F.when(others == 0, F.try_divide(units.cast("double"), n * PER_ONE)).otherwise(F.col("_c") + F.try_divide(off, n))


def _dealt(df: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """Slices kept together, dealt to ``tasks`` if given."""
    by = [*map(quoted, keys), "_slice"]
    return df.repartition(tasks, *by) if tasks else df.repartition(*by)


def rolling_per_second(df: DataFrame, metrics: Sequence[str], spans: Sequence[int], keys: Sequence[str],
                       sec: str = "t_secs", tasks: int | None = None) -> DataFrame:
    """W2 and W3 as a (keys, second) table; see :func:`rolling_avg_std`.

    Metrics become rows, so the plan is the same for one metric and for a hundred. A second of a metric is reduced to count,
    mean, squared deviation, smallest and largest value. Running sums are taken around the mean of the slice, which keeps
    large counters exact; a frame of equal values has deviation 0. Means of values below ``UNITS_BELOW`` with at most four
    decimals come from whole numbers of ten-thousandths and are rounded once, so a frame of zeros has mean 0, whatever lies around it.
    Slices are dealt to ``tasks`` if given.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(quoted(m)).cast("double").alias("x")) for i, m in enumerate(metrics)])
    tall = df.select(*map(quoted, keys), sec, F.inline(cells).alias("_i", "_x"))
    units = F.when(F.abs("_x") < UNITS_BELOW, F.round(F.col("_x") * PER_ONE)).otherwise(0).cast("bigint")
    in_units = units / PER_ONE == F.col("_x")
    secs = tall.groupBy(*map(quoted, keys), sec, "_i").agg(
        F.count("_x").alias("_n"), F.avg("_x").alias("_m"), (F.var_pop("_x") * F.count("_x")).alias("_v"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"),
        F.coalesce(F.sum(units), F.lit(0)).alias("_k"), F.count_if(~in_units).alias("_g"))
    # all metrics of a slice stay together: one exchange serves the windows and the way back to one row per second
    secs = _dealt(with_halo(secs, F.col(sec), 2 * max(spans)), keys, tasks)
    own = [*keys, "_i"]
    slice_of = Window.partitionBy(*map(quoted, own), "_slice")
    earlier = slice_of.orderBy(sec).rowsBetween(Window.unboundedPreceding, -1)
    later = slice_of.orderBy(sec).rowsBetween(1, Window.unboundedFollowing)
    secs = secs.withColumns({"_c": F.avg("_m").over(slice_of), "_p": F.last("_hi", True).over(earlier),
                             "_f": F.first("_lo", True).over(later)})

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    # a frame holds one value if no second of it holds two and no two neighbours in it differ: of the changes that
    # end by now, those that began before the frame are taken off again
    d = F.col("_n") * (F.col("_m") - F.col("_c"))
    secs = secs.withColumns({
        "_d": F.coalesce(d, F.lit(0.0)), "_q": F.coalesce(F.col("_v") + d * (F.col("_m") - F.col("_c")), F.lit(0.0)),
        "_x": flag(F.col("_lo") != F.col("_hi")), "_e": flag(F.col("_p") != F.col("_lo")),
        "_b": flag(F.col("_f") != F.col("_hi"))})
    sums: dict[str, Column] = {}  # every running sum once, however many spans use it

    def upto(name: str, hi: int) -> Column:
        column = f"_u{name}{-hi}"
        if column not in sums:
            sums[column] = _upto(F.col(f"_{name}"), own, sec, hi)
        return F.col(column)

    def moving(name: str, lo: int, hi: int = 0) -> Column:
        return upto(name, hi) - upto(name, lo - 1)

    parts: dict[str, Column] = {}
    values = []
    for w in spans:
        parts |= {f"_N{w}": moving("n", -w), f"_S{w}": moving("d", -w), f"_Q{w}": moving("q", -w),
                  f"_E{w}": moving("x", -w) + F.greatest(upto("e", 0) - upto("b", -w - 1), F.lit(0)) == 0,
                  f"_B{w}": moving("n", -2 * w, -w), f"_T{w}": moving("d", -2 * w, -w),
                  f"_K{w}": moving("k", -w), f"_G{w}": moving("g", -w),
                  f"_L{w}": moving("k", -2 * w, -w), f"_H{w}": moving("g", -2 * w, -w)}
        n, s = F.col(f"_N{w}"), F.col(f"_S{w}")
        mean = _mean(F.col(f"_K{w}"), F.col(f"_G{w}"), n, s)
        past = _mean(F.col(f"_L{w}"), F.col(f"_H{w}"), F.col(f"_B{w}"), F.col(f"_T{w}"))
        spread = F.sqrt(F.greatest(F.col(f"_Q{w}") - s * s / F.nullif(n, F.lit(0)), F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
        values += [mean.alias(f"avg_{w}"),
                   F.when(n < 2, None).when(F.col(f"_E{w}"), F.lit(0.0)).otherwise(spread).alias(f"std_{w}"),
                   F.try_divide(mean - past, past).alias(f"pct_change_{w}")]
    found = secs.withColumns(sums).withColumns(parts).filter("_own").select(
        *map(quoted, keys), "_slice", sec, F.struct("_i", F.struct(*values).alias("v")).alias("_r"))
    # one entry per metric in every second
    rows = found.groupBy(*map(quoted, keys), "_slice", sec).agg(F.array_sort(F.collect_list("_r")).alias("_r"))
    return rows.select(*map(quoted, keys), sec, *[
        F.col("_r")[i]["v"][f"{what}_{w}"].alias(f"{m}_{what}_{w}")
        for i, m in enumerate(metrics) for w in spans for what in ("avg", "std", "pct_change")])


def rolling_avg_std(df: DataFrame, metrics: Sequence[str], spans: Sequence[int], keys: Sequence[str],
                    sec: str = "t_secs") -> DataFrame:
    """Mean and sample deviation over [t-w, t], and the change of the mean against [t-2w, t-w].

    The row at t-w belongs to both frames. The change is NULL when the earlier mean is 0 or missing. The values depend
    on (keys, second) only and are joined back from that table.
    """
    return df.join(rolling_per_second(df, metrics, spans, keys, sec), [*keys, sec], "left")


def count_ratio_columns(n: str, deltas: Sequence[int], keys: Sequence[str], sec: str) -> dict[str, Column]:
    """W4 over a sliced per-second table with counts ``n``."""
    return {f"ratio_countlog_delta_{d // 60}min": F.try_divide(
        _moving(F.col(n), keys, sec, -d), F.nullif(_moving(F.col(n), keys, sec, -2 * d, -d), F.lit(0))) for d in deltas}


def priority_ratio_columns(total: str, n: str, span: int, keys: Sequence[str], sec: str) -> dict[str, Column]:
    """W5 over a sliced per-second table with sums ``total`` of ``n`` scores."""

    def mean(w: int) -> Column:
        return F.try_divide(_moving(F.coalesce(total, F.lit(0.0)), keys, sec, -w), _moving(F.col(n), keys, sec, -w))

    m = span // 60
    ratios = {f"ratio_pri_score_prev_{m}m_vs_{k * m}m": F.try_divide(mean(span), mean(k * span)) for k in (2, 4)}
    return {f"avg_pri_score_prev_{m}m": mean(span), **ratios}


def count_ratio_per_second(df: DataFrame, deltas: Sequence[int], keys: Sequence[str], sec: str = "timestamp_sec") -> DataFrame:
    """W4 as a (keys, second) table: rows in [t-d, t] / rows in [t-2d, t-d], NULL when there were none."""
    secs = _per_second(df, keys, sec, [F.count("*").alias("_n")], 2 * max(deltas))
    ratios = count_ratio_columns("_n", deltas, keys, sec)
    return secs.withColumns(ratios).filter("_own").select(*map(quoted, keys), sec, *ratios)


def log_count_ratio(df: DataFrame, deltas: Sequence[int] = (1800, 2700), keys: Sequence[str] = ("host",),
                    sec: str = "timestamp_sec") -> DataFrame:
    """W4 on every row. The ratio depends on (keys, second) only and is joined back from that table."""
    return df.join(count_ratio_per_second(df, deltas, keys, sec), [*keys, sec], "left")


def priority_ratio_per_second(df: DataFrame, pri: str = "priority_score", span: int = 900,
                              keys: Sequence[str] = ("host",), sec: str = "timestamp_sec") -> DataFrame:
    """W5 as a (keys, second) table: mean over [t-w, t], and its ratio to the means over [t-2w, t] and [t-4w, t]."""
    c = F.col(quoted(pri))
    secs = _per_second(df, keys, sec, [F.sum(c).alias("_s"), F.count(c).alias("_n")], 4 * span)
    ratios = priority_ratio_columns("_s", "_n", span, keys, sec)
    return secs.withColumns(ratios).filter("_own").select(*map(quoted, keys), sec, *ratios)


def priority_ratio(df: DataFrame, pri: str = "priority_score", span: int = 900, keys: Sequence[str] = ("host",),
                   sec: str = "timestamp_sec") -> DataFrame:
    """W5 on every row; the raw score goes."""
    return df.join(priority_ratio_per_second(df, pri, span, keys, sec), [*keys, sec], "left").drop(pri)


class _Counts:
    """How many rows of each state are in the frame, and the state of the largest count; of equal ones the lowest.

    Every change of a count puts an entry on a heap; entries that are no longer true are dropped when they come up.
    """

    def __init__(self) -> None:
        self.n: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []

    def add(self, state: int, n: int) -> None:
        self.n[state] = now = self.n.get(state, 0) + n
        if now:
            heapq.heappush(self.heap, (-now, state))

    def most(self) -> int | None:
        heap = self.heap
        while heap and self.n[heap[0][1]] != -heap[0][0]:
            heapq.heappop(heap)
        return heap[0][1] if heap else None


def swept_modes(sec: Sequence[int], state: Sequence[int | None], n: Sequence[int], at: Sequence[int], lo: int,
                hi: int) -> list[int | None]:
    """Most frequent state in [t + lo, t + hi] for every t of ``at``; ``sec`` and ``at`` are sorted.

    Each row enters the frame once and leaves it once, whatever the number of states.
    """
    counts, found = _Counts(), []
    enter = leave = 0
    for t in at:
        while enter < len(sec) and sec[enter] <= t + hi:
            if state[enter] is not None:
                counts.add(state[enter], n[enter])
            enter += 1
        while leave < enter and sec[leave] < t + lo:
            if state[leave] is not None:
                counts.add(state[leave], -n[leave])
            leave += 1
        found.append(counts.most())
    return found


def modes_per_second(df: DataFrame, cols: Sequence[str], keys: Sequence[str], sec: str = "t_secs", span: int = 1800,
                     tasks: int | None = None) -> DataFrame:
    """W6 as a (keys, second) table with both modes of every column; all ``cols`` have one type.

    Slices are dealt to ``tasks`` if given.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(quoted(c)).alias("s")) for i, c in enumerate(cols)])
    tall = df.select(*map(quoted, keys), sec, F.inline(cells).alias("_i", "_s"))
    secs = with_halo(tall.groupBy(*map(quoted, keys), sec, "_i", "_s").agg(F.count("*").alias("_n")), F.col(sec), 2 * span)
    group = [*map(quoted, keys), "_slice"]
    m, names = span // 60, []
    for c in cols:
        names += [f"{c}_mode_last_{m}min", f"{c}_mode_2nd_last_{m}min"]
    kind = df.schema[cols[0]].dataType
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in [*keys, sec]],
                           *[T.StructField(c, kind) for c in names]])
    arrow = to_arrow_schema(schema)

    def swept(key: tuple, rows: list[tuple]) -> list[tuple]:
        at = sorted({r[0] for r in rows if r[1]})
        found = []
        for i in range(len(cols)):
            times, states, n = zip(*[(r[0], r[3], r[4]) for r in rows if r[2] == i])
            found += [swept_modes(times, states, n, at, lo, hi) for lo, hi in ((-span, 0), (-2 * span, -span))]
        return [(*key, *row) for row in zip(at, *found)]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, out = None, [], []
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for key, row in zip(zip(*values[:len(group)]), zip(*values[len(group):])):
                if key != held:
                    out += swept(held[:-1], rows) if rows else []
                    held, rows = key, []
                rows.append(row)
            yield _rows_of(out, arrow)
            out = []
        yield _rows_of(swept(held[:-1], rows) if rows else [], arrow)

    return (_dealt(secs.select(*group, sec, "_own", "_i", "_s", "_n"), keys, tasks).sortWithinPartitions(*group, sec)
            .mapInArrow(sweep, schema))


def _rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def state_mode(df: DataFrame, cols: Sequence[str], keys: Sequence[str], sec: str = "t_secs", span: int = 1800) -> DataFrame:
    """Most frequent state in [t-w, t] and in [t-2w, t-w]; the lowest value wins a tie.

    Rows are counted per second and state first. A count changes only when a row enters or leaves the frame, so each slice is
    swept once, whatever the number of states and columns; a second has the same modes for all its rows. Null states do
    not count; a frame without any has no mode.
    """
    out = df
    for kind in dict.fromkeys(df.schema[c].dataType for c in cols):  # columns of one type share a plan
        same = [c for c in cols if df.schema[c].dataType == kind]
        found = modes_per_second(df, same, keys, sec, span)
        right = found.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate([*keys, sec])})
        on = [out[quoted(k)].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate([*keys, sec])]
        out = out.join(right, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])
    return out
