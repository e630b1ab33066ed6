"""Column-level helpers: numbers, component names, types, roles."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted

INT_WIDTHS = [(T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31)]


def to_numeric(df: DataFrame, cols: Sequence[str], kind: str = "float") -> DataFrame:
    """Numbers out of text, NULL where the text is not a number."""
    return df.withColumns({c: F.col(quoted(c)).try_cast(kind) for c in cols})


def component_label(name: Column) -> Column:
    """One label per routing engine and line-card slot."""
    return (F.when(name == "Routing Engine", F.lit("Routing Engine 0"))
            .when(name.rlike("(?i)fpc"), F.concat(F.lit("FPC "), F.regexp_extract(name, r"@ (\d+)", 1)))
            .otherwise(name))


def normalize_component(df: DataFrame, col: str = "component_name", out: str = "regex_component_name") -> DataFrame:
    return df.withColumn(out, component_label(F.col(quoted(col))))


def narrow_types(df: DataFrame) -> DataFrame:
    """P10: every integer column to the smallest width that holds it, doubles to floats if none overflows.

    One aggregate over the data; its single row of extremes picks the schema.
    """
    ints = [f for f in df.schema if isinstance(f.dataType, (T.ShortType, T.IntegerType, T.LongType))]
    floats = [f for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    if not ints and not floats:
        return df
    spans = [g(F.col(quoted(f.name))).alias(f"{tag}{i}")
             for i, f in enumerate(ints) for tag, g in (("lo", F.min), ("hi", F.max))]
    spans += [F.max(F.abs(F.nanvl(F.col(quoted(f.name)), F.lit(0.0)))).alias(f"mag{i}") for i, f in enumerate(floats)]
    row = df.agg(*spans).first()
    casts: dict[str, Column] = {}
    for i, f in enumerate(ints):
        lo, hi = row[f"lo{i}"], row[f"hi{i}"]
        if lo is None:
            continue
        for kind, bits in INT_WIDTHS:
            if -(1 << bits) <= lo and hi < (1 << bits):
                casts[f.name] = F.col(quoted(f.name)).cast(kind)
                break
    for i, f in enumerate(floats):
        if (row[f"mag{i}"] or 0.0) <= 3.4028234663852886e38:
            casts[f.name] = F.col(quoted(f.name)).cast("float")
    return df.withColumns(casts)


def align_columns(df: DataFrame, required: Iterable[str], categorical: Iterable[str] = ()) -> DataFrame:
    """Add what the model expects and the data lacks as NULL; categorical columns become text."""
    cats = list(categorical)
    have = set(df.columns)
    new = {c: F.lit(None).cast("string" if c in cats else "double") for c in [*required, *cats] if c not in have}
    text = {c: F.col(quoted(c)).cast("string") for c in cats if c in have}
    return df.withColumns({**text, **new}) if text or new else df


def column_roles(df: DataFrame, exclude: Sequence[str], text: Sequence[str]) -> dict[str, list[str]]:
    """Which columns are numeric, categorical, text, left out. Raises if a named column is missing."""
    missing = [c for c in [*exclude, *text] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the data: {missing}")
    apart = {*exclude, *text}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in apart]
    categorical = [c for c in df.columns if c not in apart and c not in numeric]
    return {"numeric": numeric, "categorical": categorical, "text": list(text), "exclude": list(exclude)}
