"""Lines with their templates, hour by hour, with a log of finished hours.

Each hour is mined from the catalogue of the hour before. Its rows and its catalogue go to folders of their own run, and one
row of the log, written last, names them. What the log does not name does not exist: an hour that broke off leaves folders
that nobody reads, and is done again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.operators import templates
from faultline.operators.mining_core import MinerConfig

LOG = "hour string, run string, lines bigint, clusters bigint, least bigint, most bigint, mean double"
HOUR_FORMAT = "yyyy-MM-dd-HH"


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """Finished hours: the run that counts, its lines, and number, least, most and mean size of the clusters after it.

    Should two writers have finished the same hour, the first run by name counts.
    """
    rows = spark.read.schema(LOG).option("pathGlobFilter", "*.parquet").parquet(_log_path(spark, out))
    return rows.groupBy("hour").agg(F.min_by(F.struct("*"), "run").alias("r")).select("r.*")


def _log_path(spark: SparkSession, out: str) -> str:
    path = f"{out.rstrip('/')}/log"
    try:
        spark.read.schema(LOG).parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        spark.createDataFrame([], LOG).write.mode("append").parquet(path)
    return path


def read_assigned(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all finished hours, with ``cluster_id`` and ``template_mined``, and the columns ``hour`` and ``run``."""
    done = read_log(spark, out).select("hour", "run")
    rows = spark.read.option("basePath", f"{out.rstrip('/')}/rows").parquet(f"{out.rstrip('/')}/rows")
    return rows.withColumn("hour", F.col("hour").cast("string")).join(F.broadcast(done), ["hour", "run"], "left_semi")  # one per hour


def hour_of(ts: str, hours: int = 1) -> Column:
    """First hour of the slice of ``hours`` hours, counted from 1970 in UTC, as the name of its folder.

    A null time has no hour and a name that sorts first.
    """
    sec = F.unix_seconds(F.col(quoted(ts)).cast("timestamp"))
    start = F.timestamp_seconds(F.floor(sec / (3600 * hours)) * (3600 * hours))
    return F.coalesce(F.date_format(start, HOUR_FORMAT), F.lit("0000-none"))


def assign_by_hour(df: DataFrame, tokens: str, ts: str, order_by: Sequence[str], out: str,
                   cfg: MinerConfig = MinerConfig(), hours: int = 1, after_hour: Callable[[str], None] | None = None) -> DataFrame:
    """Mine every hour that the log does not name, in order, and write its rows; returns :func:`read_log`.

    ``order_by`` is unique and puts the lines of an hour in order; hours follow each other, so all hours together come to
    what one run over (hour, ``order_by``) gives. An hour earlier than the last finished one cannot be mined any more and is
    an error. ``hours`` makes the slices longer. ``after_hour`` is called with the name of each hour between its rows and its line in the log.
    """
    spark, base = df.sparkSession, out.rstrip("/")
    log = read_log(spark, out)
    done = {r["hour"]: r["run"] for r in log.select("hour", "run").collect()}  # one row per hour
    last = max(done, default=None)
    name = hour_of(ts, hours)
    found = [r["hour"] for r in df.select(name.alias("hour")).distinct().orderBy("hour").collect()]
    late = [h for h in found if h not in done and last is not None and h < last]
    if late:
        raise ValueError(f"lines of {late} came after hour {last} was finished")
    catalog = spark.read.parquet(f"{base}/catalog/hour={last}/run={done[last]}") if done else None
    for hour in (h for h in found if h not in done):
        run = uuid.uuid4().hex
        rows = df.filter(name == hour)
        lines, made = templates.mine_templates(rows, tokens, order_by, cfg, ts=F.unix_micros(F.col(quoted(ts)).cast("timestamp")),
                                               initial=catalog)
        templates.assign_templates(rows.drop(tokens), lines, order_by).write.parquet(f"{base}/rows/hour={hour}/run={run}")
        made.write.parquet(f"{base}/catalog/hour={hour}/run={run}")
        catalog = spark.read.parquet(f"{base}/catalog/hour={hour}/run={run}")
        if after_hour is not None:
            after_hour(hour)
        live = templates.live_templates(catalog)
        written = spark.read.parquet(f"{base}/rows/hour={hour}/run={run}").agg(F.count("*").alias("lines"))
        sizes = live.agg(F.count("*").alias("clusters"), F.min("size").alias("least"), F.max("size").alias("most"),
                         F.avg("size").alias("mean"))
        (written.crossJoin(sizes)  # one row each
         .select(F.lit(hour).alias("hour"), F.lit(run).alias("run"), "lines", "clusters", "least", "most", "mean")
         .coalesce(1).write.mode("append").parquet(f"{base}/log"))
    return read_log(spark, out)
