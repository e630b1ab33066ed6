"""Scans, schema repair, sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted


def _texts(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


# fixed values: fields of a metric poll's value, of the poll itself, of a syslog row
VALUE_SCHEMA = T.StructType(_texts(
    "cpu", "heap", "state", "temp", "jnx_subscriber_active_count", "jnx_subscriber_total_count",
    "if_out_octets", "if_in_octets"))
POLL_SCHEMA = T.StructType([
    *_texts("job_id", "department", "protocol", "ip-address", "device_type", "component_name", "if_name",
            "component_index"),
    T.StructField("value", VALUE_SCHEMA), *_texts("time", "service_name"), T.StructField("is_retry", T.BooleanType())])
SYSLOG_SCHEMA = T.StructType(_texts("syslog_pri", "message", "host", "@timestamp"))
HOUR_FILE = r"^data_(\d{2})-\d{2}-\d{2}\.parquet$"


def read_events(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Parquet under an explicit schema; columns outside it are never read."""
    return spark.read.schema(schema).parquet(*([paths] if isinstance(paths, str) else paths))


def read_days(spark: SparkSession, base: str, start: date, end: date, schema: T.StructType | None = None,
              layout: str = "month", prefix: str = "") -> DataFrame:
    """Only the days in [start, end].

    ``month``: ``month=MM/day=DD`` partitions; ``date``: folders named ``prefix`` + ``YYYY-MM-DD``, absent days skipped.
    """
    days = [start + timedelta(d) for d in range((end - start).days + 1)]
    reader = spark.read.schema(schema) if schema else spark.read
    if layout == "date":
        return reader.parquet(f"{base}/{prefix}{{{','.join(d.isoformat() for d in days)}}}")
    months: dict[int, list[int]] = {}
    for d in days:
        months.setdefault(d.month, []).append(d.day)
    df = reader.option("basePath", base).parquet(base)
    wanted = [(F.col("month").cast("int") == m) & F.col("day").cast("int").isin(ds) for m, ds in months.items()]
    return df.filter(reduce(lambda a, b: a | b, wanted))


def read_hour_slice(df: DataFrame, first: int, last: int, pattern: str = HOUR_FILE) -> DataFrame:
    """S3: files whose name says an hour in [first, last]; the filter on file names prunes files before the scan."""
    hour = F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("int")
    return df.filter(hour.between(first, last))


def _places(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that tasks can open: the session's file systems are asked once per folder that they have to place."""
    conf, known = spark._jsc.hadoopConfiguration(), {}

    def place(folder: str) -> str:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(conf)
        path = store.makeQualified(path)
        return (store.resolvePath(path) if store.exists(path) else path).toString().rstrip("/")

    out = []
    for path in paths:
        folder, _, name = path.rpartition("/")
        if "://" in path and not path.startswith("viewfs:") or path.startswith("file:"):
            out.append(path)
            continue
        if folder not in known:
            known[folder] = place(folder or ("/" if path.startswith("/") else "."))
        out.append(f"{known[folder]}/{name}")
    return out


def split_paths_by_value_type(spark: SparkSession, paths: Sequence[str], col: str = "value") -> dict[str, list]:
    """{"string", "struct", "error"} -> files by the type of ``col``; files without it are skipped.

    Footers are read by tasks; only the file names come back. Folders are looked up in the session's file systems: a path
    without scheme is on the default one, a ``viewfs`` path where its mount leads.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        def open_path(path: str):
            if path.startswith(("file:", "/")):
                return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
            return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))

        for batch in batches:
            out = []
            for path, place in zip(batch["path"], batch["place"]):
                try:
                    store, inner = open_path(place)
                    field = {f.name: f.type for f in pq.read_schema(inner, filesystem=store)}.get(col)
                    if field is None:
                        continue
                    text = pa.types.is_string(field) or pa.types.is_large_string(field)
                    kind = "string" if text else "struct" if pa.types.is_struct(field) else "error"
                    out.append((path, kind, f"unexpected type: {field}" if kind == "error" else None))
                except Exception as problem:  # an unreadable file is a result here
                    out.append((path, "error", str(problem)))
            yield pd.DataFrame(out, columns=["path", "kind", "note"])

    if not paths:
        return {"string": [], "struct": [], "error": []}
    places = zip(paths, _places(spark, paths))
    table = spark.createDataFrame(places, "path string, place string").repartition(min(len(paths), 256))
    found = table.mapInPandas(look, "path string, kind string, note string").collect()
    return {"string": sorted(r.path for r in found if r.kind == "string"),
            "struct": sorted(r.path for r in found if r.kind == "struct"),
            "error": sorted((r.path, r.note) for r in found if r.kind == "error")}


def _value_struct(df: DataFrame, col: str, fields: T.StructType) -> Column:
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        return F.from_json(F.col(quoted(col)), fields)
    if isinstance(kind, T.StructType):
        have = set(kind.fieldNames())
        cells = [(F.col(f"{quoted(col)}.{quoted(f.name)}").try_cast(f.dataType) if f.name in have
                  else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
        return F.struct(*cells)
    raise TypeError(f"{col} is neither JSON text nor a struct: {kind.simpleString()}")


def normalize_schema(df: DataFrame, schema: T.StructType = POLL_SCHEMA, value_schema: T.StructType = VALUE_SCHEMA,
                     col: str = "value") -> DataFrame:
    """``value`` as a struct of ``value_schema``, every column of ``schema`` in order; what is missing is NULL."""
    cells = []
    for f in schema:
        if f.name not in df.columns:
            cells.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == col:
            cells.append(_value_struct(df, col, value_schema).alias(col))
        else:
            cells.append(F.col(quoted(f.name)).try_cast(f.dataType).alias(f.name))
    return df.select(*cells)


def union_all(dfs: Sequence[DataFrame | None]) -> DataFrame:
    """UNION ALL by name; columns a frame lacks are NULL there. Absent frames are skipped."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d for d in dfs if d is not None])


def flatten_struct(df: DataFrame, col: str = "value", fields: Sequence[str] = ("cpu", "heap", "state", "temp")) -> DataFrame:
    """Lift struct fields to columns, drop the struct."""
    return df.select("*", *[F.col(f"{quoted(col)}.{quoted(f)}").alias(f) for f in fields]).drop(col)


def load_dedup(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below ``path``, repeated rows once."""
    return (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .parquet(path).dropDuplicates())


def export(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet sink."""
    df.write.mode(mode).parquet(path)


def export_by_date(df: DataFrame, ts: str, path: str, mode: str = "overwrite") -> None:
    """One folder per date. Rows are rebalanced by date, so a heavy date gets several writers by its size."""
    dated = df.withColumn("date", F.to_date(quoted(ts))).hint("rebalance", "date")
    dated.write.mode(mode).partitionBy("date").parquet(path)


def pending_dates(df: DataFrame, done: DataFrame, col: str = "date") -> DataFrame:
    """Rows of dates after the last processed one; all rows when nothing was processed yet.

    The last date is a scalar subquery, so a partition column prunes folders before the scan.
    """
    last = done.agg(F.max(quoted(col))).scalar()
    return df.filter(last.isNull() | (F.col(quoted(col)) > last))


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("ip", "timestamp"), seq: str = "_seq") -> DataFrame:
    """Matching keys take the update, others are inserted; the update with the highest ``seq`` wins.

    Fields an update does not carry keep their old value. ``max_by`` combines on the map side.
    """
    old = base.withColumn("_new", F.lit(0)).withColumn(seq, F.lit(None).cast(updates.schema[seq].dataType))
    new = updates.withColumn("_new", F.lit(1))
    both = old.unionByName(new, allowMissingColumns=True)
    fields = [c for c in both.columns if c not in (*keys, "_new", seq)]
    kept = [c for c in fields if c not in updates.columns]
    fresh = [c for c in fields if c not in kept]
    order = F.struct("_new", seq)
    picks = [F.max_by(F.struct(*[F.col(quoted(c)) for c in fresh]), order).alias("_f")] if fresh else []
    picks += [F.max_by(quoted(c), F.when(F.col("_new") == 0, F.lit(0))).alias(c) for c in kept]
    out = both.groupBy(*map(quoted, keys)).agg(*picks)
    cols = [F.col(quoted(c)) if c in (*keys, *kept) else F.col("_f")[c].alias(c)
            for c in both.columns if c not in ("_new", seq)]
    return out.select(*cols)


def upsert_counts(base: DataFrame, updates: DataFrame, keys: Sequence[str] = ("ip", "timestamp")) -> DataFrame:
    """(upserted, modified): keys that are new, updates that hit a key already there.

    A repeated new key counts once as upserted and then as modified.
    """
    per_key = updates.groupBy(*map(quoted, keys)).agg(F.count("*").alias("_n"))
    known = base.select(*map(quoted, keys)).distinct().withColumn("_old", F.lit(1))
    joined = per_key.join(known, list(keys), "left")
    fresh = F.col("_old").isNull()
    return joined.agg(F.count_if(fresh).alias("upserted"),
                      F.coalesce(F.sum(F.when(fresh, F.col("_n") - 1).otherwise(F.col("_n"))), F.lit(0)).alias("modified"))
