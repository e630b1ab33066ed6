"""The tabular job: polls and syslog to labelled 5-minute device windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.clock import epoch_s, quoted, with_window_end
from faultline.functions.columns import normalize_component, to_numeric
from faultline.functions.text import clean_message, parse_syslog
from faultline.operators import aggregates as agg
from faultline.operators import filters, joins, rolling
from faultline.operators.order import with_halo
from faultline.plans import stand_ins
from faultline.sources.incidents import COMPONENT_SERVICE
from faultline.sources.readers import flatten_struct

# fixed values
TRAFFIC_SERVICE = "check_juniper_interface_statictis"
SUBSCRIBER_SERVICE = "check_juniper_subscribers"
KEYS = ["ip_address", "window_5min_end"]
SECOND = ["ip-address", "t_secs"]
CELLS_PER_TASK = 500_000  # numbers of polls


def syslog_windows(raw: DataFrame, parsed: bool = False) -> DataFrame:
    """Raw lines (host, timestamp, syslog_pri, message) to one row per device window.

    One pass: lines are parsed once and reduced per second; ratios, which depend on (device, second) only, are taken
    on the seconds, and a window keeps those of its last second. Halo copies carry no text.
    """
    rows = raw.withColumn("priority_score", F.col("syslog_pri").try_cast("double")).drop("syslog_pri").distinct()
    if not parsed:
        rows = clean_message(parse_syslog(rows), "message").drop("device_time")
    rows = with_window_end(rows.withColumn("timestamp_sec", epoch_s(rows, "timestamp")), "timestamp", 5)
    secs = rows.groupBy("host", "window_5min_end", "timestamp_sec").agg(
        F.count("*").alias("_n"), F.sum("priority_score").alias("_s"), F.count("priority_score").alias("_p"),
        F.array_sort(F.collect_list("message")).alias("_msgs"))
    wide = with_halo(secs, F.col("timestamp_sec"), 5400).withColumn("_msgs", F.when(F.col("_own"), F.col("_msgs")))
    ratios = {**rolling.count_ratio_columns("_n", (1800, 2700), ["host"], "timestamp_sec"),
              **rolling.priority_ratio_columns("_s", "_p", 900, ["host"], "timestamp_sec")}
    own = wide.withColumns(ratios).filter("_own")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("timestamp_sec").alias("t"), F.col("_msgs").alias("m"))))
    windows = own.groupBy("host", "window_5min_end").agg(
        F.max_by(F.struct(*ratios), "timestamp_sec").alias("_r"),
        F.lower(F.concat_ws(" ", F.flatten(F.transform(in_order, lambda r: r["m"])))).alias("combined_message"))
    return windows.select(F.col("host").alias("ip_address"), "window_5min_end", "_r.*", "combined_message")


def _by_second(polls: DataFrame, tasks: int) -> DataFrame:
    """Polls with their second, those of a device's second together; everything up to a slice of time stays where it is."""
    polls = polls.withColumn("time", F.to_timestamp("time"))
    return polls.withColumn("t_secs", epoch_s(polls, "time")).repartition(tasks, *map(quoted, SECOND))


def _poll_windows(rows: DataFrame, states: Sequence[str], metrics: Sequence[str], spans: Sequence[int], tasks: int) -> DataFrame:
    """Last poll of every window with the rolling features and modes of its second, which are looked up for that poll only."""
    rows = to_numeric(rows.select(*map(quoted, [*SECOND, "time", *states, *metrics])), metrics)
    found = [rolling.modes_per_second(rows, states, SECOND[:1], tasks=tasks)] if states else []
    found.append(rolling.rolling_per_second(rows, metrics, spans, SECOND[:1], tasks=tasks))
    rows = with_window_end(rows, "time", 5)
    tie = [c for c in rows.columns if c not in ("ip-address", "window_5min_end", "time")]
    last = agg.last_row_per_window(rows, ["ip-address", "window_5min_end"], "time", tie)
    last = last.repartition(tasks, *map(quoted, SECOND))
    for side in found:
        last = last.join(side.repartition(tasks, *map(quoted, SECOND)), SECOND, "left")
    return last.drop("time", "t_secs").withColumnRenamed("ip-address", "ip_address")


def poll_windows(polls: DataFrame, devices: DataFrame, components: Sequence[str] | None = None) -> DataFrame:
    """Normalised polls to one wide row per device window: components, subscribers, traffic.

    Without ``components`` they are looked up. Polls of each service are counted first: the number of tasks grows with the numbers
    to be worked on, so that a task's share does not grow with the input.
    """
    services = (COMPONENT_SERVICE, SUBSCRIBER_SERVICE, TRAFFIC_SERVICE)
    counts = polls.agg(*[F.count_if(F.col("service_name") == s) for s in services]).first()
    cores = polls.sparkSession.sparkContext.defaultParallelism
    polls = filters.keep_entities(polls, devices, "ip-address", "ip_address")

    def tasks(rows: int, metrics: Sequence[str]) -> int:
        return max(cores, -(-rows * len(metrics) // CELLS_PER_TASK))

    comp = normalize_component(flatten_struct(filters.component_filter(polls, COMPONENT_SERVICE)))
    components = agg.component_names(comp, "regex_component_name") if components is None else components
    metrics = [f"{c}_{v}" for c in components for v in ("cpu", "heap", "temp")]
    dealt = [tasks(counts[0], metrics)]
    # of equal polls the pivot takes one
    wide = agg.pivot_components(_by_second(comp, dealt[0]), [*SECOND, "time"], "regex_component_name",
                                ["cpu", "heap", "state", "temp"], components, "job_id")
    frames = [_poll_windows(wide, [f"{c}_state" for c in components], metrics, (900, 1800, 3600), dealt[0])]
    subscribers, octets = ["jnx_subscriber_active_count", "jnx_subscriber_total_count"], ["if_out_octets", "if_in_octets"]
    dealt += [tasks(n, subscribers) for n in counts[1:]]
    subs = flatten_struct(polls.filter(F.col("service_name") == SUBSCRIBER_SERVICE), "value", subscribers)
    frames.append(_poll_windows(_by_second(subs, dealt[1]).distinct(), [], subscribers, (900, 1800, 3600), dealt[1]))
    traffic = flatten_struct(filters.interface_filter(polls, TRAFFIC_SERVICE), "value", octets)
    frames.append(_poll_windows(_by_second(traffic, dealt[2]).distinct(), [], octets, (900, 1800), dealt[2]))
    return agg.first_non_null_merge(frames, KEYS, single=True, tasks=sum(dealt))


def labelled_windows(syslog: DataFrame, incidents: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Window features with the future-incident label, poll features attached."""
    # windows are one row per key already, and the label join keeps them so
    out = joins.label_future_windows(syslog, incidents, grid=300, dedup=False)
    return out if polls is None else joins.attach_features(out, polls, KEYS)


def device_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in stream as labelled windows: log-count ratios of the last second, number of events, label.

    Rows shrink to seconds and seconds to windows; the label join finds the windows already partitioned by its key.
    """
    rows = with_window_end(stand_ins.device(spark, sf_dir).withColumnRenamed("ip", "ip_address"), "timestamp", 5)
    secs = rows.groupBy(*KEYS, "sec").agg(F.count("*").alias("_n"))
    ratios = rolling.count_ratio_columns("_n", (1800, 2700), ["ip_address"], "sec")
    own = with_halo(secs, F.col("sec"), 5400).withColumns(ratios).filter("_own")
    windows = own.groupBy(*KEYS).agg(F.sum("_n").alias("n"), F.max_by(F.struct(*ratios), "sec").alias("_r"))
    return labelled_windows(windows.select(*KEYS, "n", "_r.*"), stand_ins.incidents(spark, sf_dir, "ip_address"))


def label_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: rows, positives, rate and devices of the labelled windows."""
    return agg.split_stats(device_windows(spark, sf_dir))
