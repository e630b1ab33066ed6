"""Queries of the sources, sinks and label sources."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans import stand_ins
from faultline.plans.registry import query, table
from faultline.plans.stand_ins import DEVICE, with_views
from faultline.session import fresh_dir
from faultline.sources import incidents as inc
from faultline.sources import readers as rd

# ---- polls: every event is one poll; JSON text and struct values in separate files

_FIELDS = ["cpu", "heap", "state", "temp"]


def _polls(spark, sf: str) -> DataFrame:
    d = stand_ins.device(spark, sf)
    k, cents = F.col("k").cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string")
    return d.select(F.col("event_id").cast("string").alias("job_id"), F.col("ip").alias("ip-address"),
                    F.concat(F.lit("FPC: slot @ "), k).alias("component_name"),
                    F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"),
                    F.lit("check_juniper_component").alias("service_name"), k.alias("k"), cents.alias("cents"),
                    "event_type")


def _poll_files(spark, sf: str) -> tuple[str, str]:
    """Two folders: polls with a JSON value (clicks, views), polls with a struct value (the others)."""
    polls, root = _polls(spark, sf), fresh_dir(spark, "polls")
    as_json = F.to_json(F.struct(F.col("cents").alias("cpu"), F.col("k").alias("state")))
    as_struct = F.struct(F.col("cents").cast("bigint").alias("cpu"), F.col("k").alias("heap"))
    early = F.col("event_type").isin("click", "view")
    polls.filter(early).withColumn("value", as_json).drop("k", "cents", "event_type").write.parquet(f"{root}/text")
    polls.filter(~early).withColumn("value", as_struct).drop("k", "cents", "event_type").write.parquet(f"{root}/struct")
    return f"{root}/text", f"{root}/struct"


@query("s1_read_events", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    schema = T.StructType.fromDDL("event_id bigint, user_id bigint, event_type string")
    return rd.read_events(spark, f"{sf}/events.parquet", schema)


@query("s2_read_days", """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'""")
def _(spark, sf):
    root = fresh_dir(spark, "days")
    e = table(spark, sf, "events")
    (e.select("event_id", "event_type", F.date_format("ts", "MM").alias("month"), F.date_format("ts", "dd").alias("day"))
     .repartition("month", "day").write.partitionBy("month", "day").parquet(root))
    schema = T.StructType.fromDDL("event_id bigint, event_type string, month string, day string")
    df = rd.read_days(spark, root, date(2024, 1, 5), date(2024, 1, 11), schema)
    return df.select("event_id", "event_type", F.concat(F.lit("2024-"), "month", F.lit("-"), "day").alias("day"))


@query("s2_read_date_folders", """
SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-28' AND DATE '2024-02-02'""")
def _(spark, sf):
    root = fresh_dir(spark, "dates")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("d"))
    rows.repartition("d").write.partitionBy("d").parquet(root)
    schema = T.StructType.fromDDL("event_id bigint, event_type string")
    return rd.read_days(spark, root, date(2024, 1, 28), date(2024, 2, 2), schema, layout="date", prefix="d=")


@query("s3_read_hour_slice", "SELECT event_id, event_type FROM events WHERE hour(ts) BETWEEN 8 AND 11")
def _(spark, sf):
    root = fresh_dir(spark, "hours")
    rows = table(spark, sf, "events").select("event_id", "event_type", F.hour("ts").alias("h"))
    rows.repartition("h").write.partitionBy("h").parquet(root)
    # name the files as the collector does
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(conf)
    flat = hadoop.Path(f"{root}-named")
    fs.mkdirs(flat)
    for i, f in enumerate(fs.globStatus(hadoop.Path(f"{root}/h=*/*.parquet"))):
        hour = int(f.getPath().getParent().getName().split("=")[1])
        minute, second = divmod(i, 60)
        if minute > 99 or not fs.rename(f.getPath(), hadoop.Path(flat, f"data_{hour:02d}-{minute:02d}-{second:02d}.parquet")):
            raise OSError(f"cannot name {f.getPath()}")
    return rd.read_hour_slice(spark.read.parquet(f"{root}-named"), 8, 11)


@query("s4_split_paths_by_value_type", """
SELECT CASE WHEN event_type IN ('click', 'view') THEN 'string' ELSE 'struct' END AS kind, NULL AS note, count(*) AS found,
       sum(event_id) AS ids FROM events GROUP BY ALL
UNION ALL SELECT 'error', 'unexpected type: double', count(*), sum(event_id) FROM events""")
def _(spark, sf):
    text, struct = _poll_files(spark, sf)
    paths = [*spark.read.parquet(text).inputFiles(), *spark.read.parquet(struct).inputFiles(),
             f"file://{sf}/events.parquet"]
    found = rd.split_paths_by_value_type(spark, paths)
    files = [(kind, None, name) for kind in ("string", "struct") for name in found[kind]]
    files += [("error", note, name) for name, note in found["error"]]
    parts = []
    for kind, note in sorted({f[:2] for f in files}, key=str):
        # the events themselves call it event_id
        rows = spark.read.parquet(*(name for k, n, name in files if (k, n) == (kind, note)))
        ids = F.sum(F.col("event_id" if kind == "error" else "job_id").cast("bigint"))
        parts.append(rows.agg(F.count("*").alias("found"), ids.alias("ids")).select(
            F.lit(kind).alias("kind"), F.lit(note).cast("string").alias("note"), "found", "ids"))
    return rd.union_all(parts)


@query("s5_normalize_schema", with_views("""
SELECT CAST(event_id AS VARCHAR) AS job_id, ip AS ip_address, cents AS cpu,
       CASE WHEN event_type IN ('click', 'view') THEN NULL ELSE CAST(k AS VARCHAR) END AS heap,
       CASE WHEN event_type IN ('click', 'view') THEN CAST(k AS VARCHAR) END AS state,
       CAST(NULL AS VARCHAR) AS temp, CAST(NULL AS BOOLEAN) AS is_retry
FROM (SELECT *, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents FROM device)""", device=DEVICE))
def _(spark, sf):
    text, struct = _poll_files(spark, sf)
    df = rd.union_all([rd.normalize_schema(spark.read.parquet(p)) for p in (text, struct)])
    return rd.flatten_struct(df, "value", _FIELDS).select("job_id", F.col("`ip-address`").alias("ip_address"),
                                                          *_FIELDS, "is_retry")


@query("s6_union_all", """
SELECT event_id, value, CAST(NULL AS VARCHAR) AS props FROM events WHERE event_type = 'click'
UNION ALL BY NAME SELECT event_id, CAST(NULL AS DOUBLE) AS value, props FROM events WHERE event_type <> 'click'""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return rd.union_all([e.filter("event_type = 'click'").select("event_id", "value"), None,
                         e.filter("event_type <> 'click'").select("props", "event_id")])


@query("s7_flatten_struct", "SELECT event_id, event_type, value AS v FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.struct("event_type", F.col("value").alias("v")).alias("s"))
    return rd.flatten_struct(e, "s", ["event_type", "v"])


@query("s8_load_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def _(spark, sf):
    root = fresh_dir(spark, "twice")
    e = table(spark, sf, "events").select("user_id", "event_type")
    e.write.parquet(f"{root}/a/x")
    e.write.parquet(f"{root}/b")
    return rd.load_dedup(spark, root)


@query("s9_export", "SELECT event_id, value FROM events")
def _(spark, sf):
    out = fresh_dir(spark, "export")
    rd.export(table(spark, sf, "events").select("event_id", "value"), out)
    return spark.read.parquet(out)


@query("s10_export_by_date", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, sum(event_id) AS ids FROM events GROUP BY 1""")
def _(spark, sf):
    out = fresh_dir(spark, "bydate")
    rd.export_by_date(table(spark, sf, "events"), "ts", out)
    return spark.read.parquet(out).groupBy(F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("s11_pending_dates", """
SELECT event_id, CAST(ts AS DATE) AS date FROM events
WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events WHERE ts < TIMESTAMP '2024-01-12 12:00:00')""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("date"))
    done = e.filter("ts < timestamp_ntz'2024-01-12 12:00:00'").select("date").distinct()
    return rd.pending_dates(e, done).select("event_id", "date")


_UPSERT_BASE = """
SELECT user_id, event_type, max(value) AS value, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY ALL"""


def _upsert_input(spark, sf):
    e = table(spark, sf, "events")
    base = e.filter("event_type <> 'signup'").groupBy("user_id", "event_type").agg(
        F.max("value").alias("value"), F.count("*").alias("n"))
    return base, e.filter("value > 50").select("user_id", "event_type", "value", F.col("event_id").alias("_seq"))


@query("s12_upsert", f"""
WITH base AS ({_UPSERT_BASE}),
upd AS (SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events WHERE value > 50 GROUP BY ALL)
SELECT coalesce(b.user_id, u.user_id) AS user_id, coalesce(b.event_type, u.event_type) AS event_type,
       coalesce(u.value, b.value) AS value, b.n
FROM base b FULL JOIN upd u ON b.user_id = u.user_id AND b.event_type = u.event_type""")
def _(spark, sf):
    base, updates = _upsert_input(spark, sf)
    return rd.upsert(base, updates, ["user_id", "event_type"])


@query("s12_upsert_counts", f"""
WITH base AS ({_UPSERT_BASE}),
j AS (SELECT e.user_id, e.event_type, count(*) AS c, bool_or(b.user_id IS NOT NULL) AS old
      FROM events e LEFT JOIN base b ON b.user_id = e.user_id AND b.event_type = e.event_type
      WHERE e.value > 50 GROUP BY ALL)
SELECT count(*) FILTER (NOT old) AS upserted, CAST(sum(CASE WHEN old THEN c ELSE c - 1 END) AS BIGINT) AS modified FROM j""")
def _(spark, sf):
    base, updates = _upsert_input(spark, sf)
    return rd.upsert_counts(base, updates, ["user_id", "event_type"])


_CHECKS = """
SELECT ip, timestamp AS time, CASE WHEN event_type = 'purchase' THEN 'other' ELSE 'check_juniper_component' END AS service_name,
       CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 10 THEN 'n/a' ELSE CAST(k % 11 AS VARCHAR) END AS state,
       CASE k % 4 WHEN 0 THEN 'FPC: slot @ ' || k WHEN 1 THEN 'Routing Engine' WHEN 2 THEN 'fpc @ ' || k ELSE 'Fan' END AS component_name
FROM device"""


def checks(spark, sf):
    """Component checks with up, down, missing and unreadable states."""
    d, k = stand_ins.device(spark, sf), F.col("k")
    left, word = k % 11, k.cast("string")
    return d.select(
        F.col("ip").alias("ip-address"), F.col("timestamp").alias("@timestamp"),
        F.when(F.col("event_type") == "purchase", "other").otherwise("check_juniper_component").alias("service_name"),
        F.when(left == 0, None).when(left == 10, "n/a").otherwise(left.cast("string")).alias("state"),
        F.when(k % 4 == 0, F.concat(F.lit("FPC: slot @ "), word)).when(k % 4 == 1, "Routing Engine")
        .when(k % 4 == 2, F.concat(F.lit("fpc @ "), word)).otherwise("Fan").alias("component_name"))


@query("s13_extract_incidents", with_views("""
SELECT ip AS ip_address, time, 'DOWN' AS agg_status FROM checks
WHERE time >= TIMESTAMP '2024-01-03' AND time < TIMESTAMP '2024-01-20' AND service_name = 'check_juniper_component'
  AND (state IS NULL OR state NOT IN ('2', '7'))
  AND (contains(component_name, 'FPC') OR contains(component_name, 'Routing Engine'))
""", device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    return inc.extract_incidents(checks(spark, sf), "2024-01-03", "2024-01-20")


@query("s14_topology_pairs", """
SELECT o_orderdate AS time, c_name AS local_device_name, 'ip-' || c_custkey AS local_device_ip,
       n_name AS remote_device_name, 'ip-n' || n_nationkey AS remote_device_ip,
       'ae' || c_custkey % 7 AS local_aggregate, 'ae' || n_nationkey % 5 AS remote_aggregate
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
  AND c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') AND o_orderstatus <> 'P' AND n_regionkey <> 2""")
def _(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    links = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("o_orderdate").alias("@timestamp"), F.col("c_name").alias("local_device_name"),
        F.concat(F.lit("ip-"), F.col("c_custkey").cast("string")).alias("local_device_ip"),
        F.when(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"), inc.LOCAL_FUNCTION).otherwise("other")
        .alias("local_device_function"),
        F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("remote_device_name"),
        F.concat(F.lit("ip-n"), F.col("n_nationkey").cast("string")).alias("remote_device_ip"),
        F.when(F.col("o_orderstatus") != "P", inc.REMOTE_FUNCTION).otherwise("other").alias("remote_device_function"),
        F.struct(F.concat(F.lit("ae"), (F.col("c_custkey") % 7).cast("string")).alias("aggregate_name")).alias("local_data"),
        F.struct(F.concat(F.lit("ae"), (F.col("n_nationkey") % 5).cast("string")).alias("aggregate_name")).alias("remote_data")))
    return inc.topology_pairs(links, "1996-01-01", "1998-01-01").withColumnRenamed("@timestamp", "time")


@query("s15_time_slice", """
SELECT event_id, date_trunc('hour', ts) AS slice FROM events
WHERE ts >= TIMESTAMP '2024-01-02 06:00:00' AND ts < TIMESTAMP '2024-01-09 18:00:00'""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return inc.time_slice(e, "2024-01-02 06:00:00", "2024-01-09 18:00:00", "hour", "ts").select("event_id", "slice")


_KINDS = {"click": "snmp_line_card_down_label", "view": "snmp_subscriber_label", "purchase": "snmp_traffic_label",
          "signup": "snmp_trap_link_down_label", "error": "syslog_error_label"}


@query("s16_harmonize_labels", """
SELECT DISTINCT 'dev-' || user_id AS ip_address, t AS time, kind AS label_type
FROM (SELECT user_id, CASE WHEN event_type IN ('signup', 'error') THEN date_trunc('hour', ts)
                           ELSE date_trunc('hour', ts) - INTERVAL 7 HOUR END AS t,
             CASE event_type WHEN 'click' THEN 'snmp_line_card_down_label' WHEN 'view' THEN 'snmp_subscriber_label'
                  WHEN 'purchase' THEN 'snmp_traffic_label' WHEN 'signup' THEN 'snmp_trap_link_down_label'
                  ELSE 'syslog_error_label' END AS kind FROM events)
WHERE t BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-25 05:00:00'
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def _(spark, sf):
    e = table(spark, sf, "events")
    ip = F.concat(F.lit("dev-"), F.col("user_id").cast("string"))
    sources = {}
    for kind, label in _KINDS.items():
        col, time, _local = inc.LABEL_SOURCES[label]
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        sources[label] = e.filter(F.col("event_type") == kind).select(ip.alias(col), hour.alias(time))
    allow = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("ip_address"))
    out = inc.harmonize_labels(sources, allow, "2024-01-02 00:00:00", "2024-01-25 05:00:00")
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))
