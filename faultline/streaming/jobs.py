"""Structured Streaming forms of the windowed, labelling, mining and upsert steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.clock import quoted
from faultline.operators.mining_core import MinerConfig
from faultline.operators.templates import load_catalog, mine_templates, release, save_catalog
from faultline.session import fresh_dir, tidy_shuffles
from faultline.streaming.buckets import ROWS, BucketTable


def stream_incremental_files(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None,
                             files_per_trigger: int | None = None) -> DataFrame:
    """Files that appear below ``path``; the query's checkpoint remembers which were taken."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_window_features(sdf: DataFrame, host: str = "host", ts: str = "timestamp", pri: str = "priority_score",
                           msg: str = "message", delay: str = "10 minutes") -> DataFrame:
    """Per device and 5-minute window the number of lines, mean priority and the ordered text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(quoted(ts)).alias("t"), F.col(quoted(msg)).alias("m"))))
    return (sdf.withWatermark(ts, delay).groupBy(quoted(host), F.window(quoted(ts), "5 minutes"))
            .agg(F.count("*").alias("n"), F.avg(quoted(pri)).alias("avg_pri"),
                 F.lower(F.concat_ws(" ", F.transform(rows, lambda r: r["m"]))).alias("combined_message"))
            .select(quoted(host), F.col("window.end").alias("window_5min_end"), "n", "avg_pri", "combined_message"))


def stream_hopping(sdf: DataFrame, host: str = "host", ts: str = "timestamp", width: str = "15 minutes",
                   step: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """R2: sliding counts. Windows are [end - width, end): unlike W8 an event at exactly ``end`` is in the next one."""
    return (sdf.withWatermark(ts, delay).groupBy(quoted(host), F.window(quoted(ts), width, step))
            .agg(F.count("*").alias("n")).select(quoted(host), F.col("window.end").alias("window_end"), "n"))


def stream_label(windows: DataFrame, incidents: DataFrame, key: str = "ip_address", end: str = "window_5min_end",
                 time: str = "time", gap: int = 300, horizon: int = 1200, delay: str = "10 minutes",
                 windows_delay: str | None = None) -> DataFrame:
    """J1 on two streams: left outer interval join, then one row per window.

    Both time columns carry watermarks, so the state of the join and of the aggregation is bounded. ``end`` of a
    windowed aggregate comes from ``window_time`` and has its watermark already, one microsecond before the end; pass
    ``windows_delay`` for windows from a source instead (a second watermark on the same rows would hold back the first).
    """
    w = windows.select(F.col(quoted(key)).alias(key), F.col(quoted(end)).alias("_w"))
    tick = F.expr(f"INTERVAL {0 if windows_delay else '0.000001'} SECONDS")
    if windows_delay:
        w = w.withWatermark("_w", windows_delay)
    stop = F.col("_w") + tick
    i = (incidents.select(F.col(quoted(key)).alias("_ip"), F.col(quoted(time)).alias("_hit"))
         .withWatermark("_hit", delay))
    # the plain bounds are what the state clean-up understands; the first microsecond is settled below
    within = F.expr(f"`{key}` = _ip AND _hit >= _w AND _hit <= _w + INTERVAL {horizon + 1} SECONDS")
    seen = (F.col("_hit") >= stop) & (F.col("_hit") <= stop + F.expr(f"INTERVAL {horizon} SECONDS"))
    far = seen & (F.col("_hit") >= stop + F.expr(f"INTERVAL {gap} SECONDS"))
    flags = w.join(i, within, "leftOuter").groupBy(quoted(key), "_w").agg(
        F.coalesce(F.max(seen.cast("int")), F.lit(0)).alias("_hits"),
        F.coalesce(F.max(far.cast("int")), F.lit(0)).alias("label"))
    return flags.filter((F.col("label") == 1) | (F.col("_hits") == 0)).select(quoted(key), stop.alias(end), "label")


def stream_mine_templates(sdf: DataFrame, tokens: str, order_by: Sequence[str], cfg: MinerConfig = MinerConfig(),
                          root: str | None = None) -> DataFrame:
    """M1 on a stream: every micro-batch is mined on from the catalogue that the one before it left.

    Lines of a micro-batch are taken in ``order_by`` order and spread as in M1, so no token count is one task. Batch n
    reads catalogue n and writes its lines and catalogue n + 1 into folders of their own; a repeated batch writes the same
    folders again, and a second run on ``root`` goes on from where the first one stopped. Returns the lines of all batches.
    """
    spark = sdf.sparkSession
    root = root or fresh_dir(spark, "stream-mining")
    rows = sdf.select(*map(quoted, order_by), F.col(quoted(tokens)).alias(tokens))

    def apply(batch: DataFrame, number: int) -> None:
        before = load_catalog(spark, f"{root}/catalogue/{number}") if number else None
        lines, catalog = mine_templates(batch, tokens, order_by, cfg, initial=before)
        with tidy_shuffles(batch.sparkSession):
            lines.write.option("compression", "zstd").mode("overwrite").parquet(f"{root}/lines/batch={number}")
            save_catalog(catalog, f"{root}/catalogue/{number + 1}")
        release(lines, catalog)

    query = (rows.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/marks")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        return spark.read.option("basePath", f"{root}/lines").parquet(f"{root}/lines").drop("batch")
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return mine_templates(spark.createDataFrame([], rows.schema), tokens, order_by, cfg)[0]  # no batch so far


def run_available(sdf: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into a new folder of the shared storage and read that back."""
    spark = sdf.sparkSession
    out, marks = fresh_dir(spark, label), fresh_dir(spark, f"{label}-marks")
    query = (sdf.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(sdf.schema).parquet(out)


BUCKETS = 64


def stream_upsert(sdf: DataFrame, base: DataFrame, keys: Sequence[str], seq: str, root: str | None = None,
                  buckets: int = BUCKETS, rows_per_bucket: int = ROWS) -> DataFrame:
    """S12 per micro-batch on a table cut by key into ``buckets`` at first, and into more as it grows.

    A batch rewrites the buckets that it touches, and those that split, into a folder of its own; the manifest of the next
    version says which folder holds each bucket (:class:`BucketTable`). A repeated batch starts from the same manifest and
    writes the same folders, so a restart on ``root`` does no harm. Folders that the last two manifests do not name are deleted.
    """
    root = root or fresh_dir(sdf.sparkSession, "upsert")
    held = BucketTable(sdf.sparkSession, root, base.schema, list(keys), rows_per_bucket)
    if held.last() is None:
        held.create(base, buckets)
    query = (sdf.writeStream.foreachBatch(lambda batch, number: held.apply(batch, number, seq))
             .option("checkpointLocation", f"{root}/marks").trigger(availableNow=True).start())
    query.awaitTermination()
    return held.read(held.last())
