"""Time columns: whole seconds, window ends, ceilings, zone changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH_NTZ = "timestamp_ntz'1970-01-01 00:00:00'"


def quoted(name: str) -> str:
    """Back-quoted column name (``ip-address`` and the like need it)."""
    return "`" + name.replace("`", "``") + "`"


def is_ntz(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def epoch_s(df: DataFrame, name: str) -> Column:
    """Whole seconds since 1970. Zone-free columns are read as they stand, without the session zone."""
    return floor_s(epoch_us(df, name), 1) if is_ntz(df, name) else F.unix_timestamp(F.col(quoted(name)))


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970."""
    c = F.col(quoted(name))
    if is_ntz(df, name):
        # from calendar parts: timestampdiff would go through the session zone and its summer time
        part = F.expr(f"cast(extract(SECOND FROM {quoted(name)}) * 1000000 AS bigint)")
        minutes = (F.unix_date(c.cast("date")).cast("bigint") * 1440 + F.hour(c) * 60 + F.minute(c))
        return minutes * 60_000_000 + part
    return F.unix_micros(c)


def from_epoch_s(df: DataFrame, like: str, seconds: Column) -> Column:
    """Inverse of :func:`epoch_s`, in the type of column ``like``."""
    if is_ntz(df, like):
        return F.expr(EPOCH_NTZ) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    return F.timestamp_seconds(seconds)


def with_window_end(df: DataFrame, ts: str = "time", minutes: int = 5, name: str | None = None) -> DataFrame:
    """End of the ``minutes`` window, counted from local midnight.

    Windows are closed on the left: an event on a boundary belongs to the next end.
    """
    kind = df.schema[ts].dataType
    c = F.col(quoted(ts))
    bucket = F.floor((F.hour(c) * 60 + F.minute(c)) / minutes).cast("int") * minutes + minutes
    end = F.timestamp_add("MINUTE", bucket, c.cast("date").cast(kind))
    return df.withColumn(name or f"window_{minutes}min_end", end)


def floor_s(micros: Column, step_s: int) -> Column:
    """Floor of a microsecond clock to ``step_s`` seconds, as epoch seconds, in integer arithmetic."""
    step = F.lit(step_s * 1_000_000).cast("bigint")
    return ((micros - F.pmod(micros, step)) / F.lit(1_000_000)).cast("bigint")


def ceil_s(micros: Column, step_s: int) -> Column:
    """Ceiling of a microsecond clock to ``step_s`` seconds, as epoch seconds; exact multiples stay."""
    return -floor_s(-micros, step_s)


def with_ceil_ts(df: DataFrame, ts: str, step_s: int, name: str = "ceil_ts") -> DataFrame:
    """W10 on a column: epoch second of the ceiling."""
    return df.withColumn(name, ceil_s(epoch_us(df, ts), step_s))


def parse_ts(df: DataFrame, name: str, fmt: str | None = None) -> DataFrame:
    """P5: text to timestamp; text that does not parse becomes NULL."""
    args = (F.lit(fmt),) if fmt else ()
    return df.withColumn(name, F.try_to_timestamp(F.col(quoted(name)), *args))


def localize(df: DataFrame, name: str, zone: str) -> DataFrame:
    """P5: wall-clock time of ``zone`` to UTC."""
    kind = df.schema[name].dataType
    return df.withColumn(name, F.to_utc_timestamp(F.col(quoted(name)), zone).cast(kind))


def local_text(df: DataFrame, name: str, zone: str, out: str | None = None) -> DataFrame:
    """P5: UTC time to wall-clock text of ``zone``."""
    return df.withColumn(
        out or name, F.date_format(F.from_utc_timestamp(F.col(quoted(name)), zone), "yyyy-MM-dd HH:mm:ss"))
