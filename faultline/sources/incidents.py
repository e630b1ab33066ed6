"""Incident, topology and label sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.clock import quoted
from faultline.sources.readers import union_all

# fixed values
COMPONENT_SERVICE = "check_juniper_component"
LOCAL_FUNCTION = "Metro BroadBand BRAS"
REMOTE_FUNCTION = "Metro BroadBand Router Edge"
LOCAL_ZONE = "Asia/Ho_Chi_Minh"
# label source -> (device column, time column, time is naive local)
LABEL_SOURCES = {
    "snmp_line_card_down_label": ("ip-address", "time", True),
    "snmp_subscriber_label": ("ip-address", "time", True),
    "snmp_traffic_label": ("bras_ip", "time", True),
    "snmp_trap_link_down_label": ("host", "@timestamp", False),
    "syslog_error_label": ("host", "@timestamp", False),
}


def _between(df: DataFrame, col: str, t0, t1) -> DataFrame:
    kind = df.schema[col].dataType
    c = F.col(quoted(col))
    return df.filter((c >= F.lit(t0).cast(kind)) & (c < F.lit(t1).cast(kind)))


def extract_incidents(df: DataFrame, t0, t1, ip: str = "ip-address", time: str = "@timestamp", state: str = "state",
                      name: str = "component_name", service: str = "service_name") -> DataFrame:
    """Component checks in [t0, t1) that are not in an up state. A missing state counts as down here."""
    up = F.coalesce(F.col(quoted(state)).cast("string").isin("2", "7"), F.lit(False))
    named = F.col(quoted(name)).contains("FPC") | F.col(quoted(name)).contains("Routing Engine")
    rows = _between(df, time, t0, t1).filter((F.col(quoted(service)) == COMPONENT_SERVICE) & ~up & named)
    return rows.select(F.col(quoted(ip)).alias("ip_address"), F.col(quoted(time)).alias("time"),
                       F.lit("DOWN").alias("agg_status")).orderBy("time", "ip_address")


def topology_pairs(df: DataFrame, t0, t1, time: str = "@timestamp") -> DataFrame:
    """Links in [t0, t1) from a BRAS to an edge router with a known remote name; both aggregate names lifted."""
    rows = _between(df, time, t0, t1).filter(
        (F.col("local_device_function") == LOCAL_FUNCTION) & (F.col("remote_device_function") == REMOTE_FUNCTION)
        & F.col("remote_device_name").isNotNull())
    return rows.select(F.col(quoted(time)), "local_device_name", "local_device_ip", "remote_device_name",
                       "remote_device_ip", F.col("local_data.aggregate_name").alias("local_aggregate"),
                       F.col("remote_data.aggregate_name").alias("remote_aggregate"))


def time_slice(df: DataFrame, t0, t1, unit: str = "hour", time: str = "@timestamp") -> DataFrame:
    """Rows in [t0, t1) with the start of their hour or day as ``slice``, the partition column of the sink."""
    kind = df.schema[time].dataType
    return _between(df, time, t0, t1).withColumn("slice", F.date_trunc(unit, quoted(time)).cast(kind))


def harmonize_labels(sources: Mapping[str, DataFrame], allow: DataFrame | None = None, t0=None, t1=None,
                     zone: str = LOCAL_ZONE) -> DataFrame:
    """(ip_address, time in UTC, label_type) of all label sources; allow-list, distinct, t0 <= time <= t1."""
    parts = []
    for kind, df in sources.items():
        if kind not in LABEL_SOURCES:
            raise ValueError(f"unknown label source {kind}")
        ip, time, local = LABEL_SOURCES[kind]
        t = F.col(quoted(time)).cast("timestamp")
        parts.append(df.select(F.col(quoted(ip)).alias("ip_address"),
                               (F.to_utc_timestamp(t, zone) if local else t).alias("time"),
                               F.lit(kind).alias("label_type")))
    out = union_all(parts)
    if t0 is not None:
        out = out.filter(F.col("time") >= F.lit(t0).cast("timestamp"))
    if t1 is not None:
        out = out.filter(F.col("time") <= F.lit(t1).cast("timestamp"))
    if allow is not None:
        out = out.join(allow.select(F.col("ip_address")).distinct(), "ip_address", "left_semi")
    return out.distinct()
