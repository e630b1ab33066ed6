"""Row filters: devices, components, down states, time bounds, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.operators.order import global_rank, running_sums

# fixed values: device states that count as up
UP_STATES = (2, 7)


def keep_entities(df: DataFrame, ids: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """Keep rows whose ``col`` is in the allow-list table. The list stays a table; nothing is collected."""
    return df.join(ids.select(F.col(quoted(id_col or col)).alias(col)), col, "left_semi")


def exclude_entities(df: DataFrame, ids: DataFrame, col: str, id_col: str | None = None) -> DataFrame:
    """Drop rows whose ``col`` is in the deny-list table."""
    return df.join(ids.select(F.col(quoted(id_col or col)).alias(col)), col, "left_anti")


def component_filter(df: DataFrame, service: str, name_col: str = "component_name",
                     service_col: str = "service_name") -> DataFrame:
    """One service, line cards and routing engines only."""
    return df.filter((F.col(quoted(service_col)) == service)
                     & F.col(quoted(name_col)).rlike("(?i)fpc|routing engine"))


def interface_filter(df: DataFrame, service: str, name_col: str = "if_name",
                     service_col: str = "service_name", prefix: str = "et-") -> DataFrame:
    """One service, interfaces whose name starts with ``prefix``."""
    return df.filter((F.col(quoted(service_col)) == service) & F.col(quoted(name_col)).startswith(prefix))


def down_labels(df: DataFrame, ip: str = "ip-address", time: str = "time", state: str = "state") -> DataFrame:
    """Distinct (device, time) with a numeric state that is not an up state. NULL and non-numbers are dropped."""
    down = ~F.col(quoted(state)).try_cast("bigint").isin(*UP_STATES)
    return (df.filter(down).select(F.col(quoted(ip)).alias("ip_address"), F.col(quoted(time)).alias("time"))
            .distinct().withColumn("agg_status", F.lit("DOWN")))


def time_bounds(df: DataFrame, col: str, lo=None, hi=None, slack: str | None = None) -> DataFrame:
    """Lo <= col <= hi, both ends in. ``slack`` (e.g. ``20 minutes``) extends the upper end."""
    kind = df.schema[col].dataType
    c = F.col(quoted(col))
    if lo is not None:
        df = df.filter(c >= F.lit(lo).cast(kind))
    if hi is not None:
        top = F.lit(hi).cast(kind)
        df = df.filter(c <= (top + F.expr(f"INTERVAL {slack}") if slack else top))
    return df


def drop_invalid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows with a NULL in one of ``cols`` go."""
    return df.dropna(subset=list(cols))


def distinct_rows(df: DataFrame, cols: Sequence[str] | None = None, tie: Sequence[str] | None = None) -> DataFrame:
    """Whole rows, or one row per ``cols``: the smallest by ``tie`` (default: all other columns)."""
    if cols is None:
        return df.distinct()
    rest = [c for c in df.columns if c not in cols]
    if not rest:
        return df.select(*map(quoted, cols)).distinct()
    first = [*(tie or []), *[c for c in rest if c not in (tie or [])]]
    picked = df.groupBy(*map(quoted, cols)).agg(F.min(F.struct(*[F.col(quoted(c)) for c in first])).alias("_row"))
    return picked.select(*map(quoted, cols), "_row.*").select(*map(quoted, df.columns))


def chrono_split(df: DataFrame, col: str, start, split, end) -> tuple[DataFrame, DataFrame]:
    """Start <= t <= split for training, split < t <= end for testing."""
    kind = df.schema[col].dataType
    t, cut = F.col(quoted(col)), F.lit(split).cast(kind)
    return (df.filter((t <= cut) & (t >= F.lit(start).cast(kind))),
            df.filter((t > cut) & (t <= F.lit(end).cast(kind))))


def ratio_split(df: DataFrame, col: str, ratio: float = 0.7, tie: str | None = None,
                at=None) -> tuple[DataFrame, DataFrame]:
    """The first int(n * ratio) rows by time and the rest; or ``t < at`` and ``t >= at``.

    Two filters around the boundary's keys. Only rows that share these keys are numbered, in any order, if some of them belong
    to the head and some to the rest.
    """
    if at is not None:
        cut = F.lit(at).cast(df.schema[col].dataType)
        return df.filter(F.col(quoted(col)) < cut), df.filter(F.col(quoted(col)) >= cut)
    keys = [col, *([tie] if tie else [])]
    upto = running_sums(df.groupBy(*map(quoted, keys)).agg(F.count("*").alias("_n")), keys, {"_upto": "_n"})
    head = int((upto.agg(F.max("_upto")).first()[0] or 0) * ratio)
    last = upto.filter((F.col("_upto") >= head) & (F.col("_upto") - F.col("_n") < head)).first()
    if last is None:
        return df.filter(F.lit(False)), df
    ahead, tied = F.lit(False), F.lit(True)
    for k in keys:  # NULL comes first
        edge = F.lit(last[k]).cast(df.schema[k].dataType)
        if last[k] is not None:
            ahead = ahead | (tied & (F.col(quoted(k)).isNull() | (F.col(quoted(k)) < edge)))
        tied = tied & F.col(quoted(k)).eqNullSafe(edge)
    if last["_upto"] == head:
        return df.filter(ahead | tied), df.filter(~(ahead | tied))
    some = head - (last["_upto"] - last["_n"])
    ranked = global_rank(df.filter(tied).withColumn("_u", F.rand(0)), ["_u"], name="_r").drop("_u")
    return (df.filter(ahead).unionByName(ranked.filter(F.col("_r") < some).drop("_r")),
            df.filter(~(ahead | tied)).unionByName(ranked.filter(F.col("_r") >= some).drop("_r")))
