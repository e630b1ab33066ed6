"""The given tables in the roles of device data. Each view has a Spark and a SQL form that say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.clock import epoch_s
from faultline.functions.text import tokens_of
from faultline.plans.registry import table

def spread(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """A table of few files over all cores, before CPU-heavy text work, in tasks of bounded size. Inputs of as many splits
    stay as they are."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))
    return df.repartition(tasks, key) if df.rdd.getNumPartitions() < tasks else df


# ---- events as a device stream: user -> device, 'error' -> incident, props.k -> component or priority

DEVICE = """
SELECT event_id, ts AS timestamp, 'dev-' || user_id AS ip, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
       CAST(floor(epoch(ts)) AS BIGINT) AS sec,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
FROM events
"""


def device(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("timestamp"),
                    F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("ip"), "event_type", "value",
                    F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
                    epoch_s(e, "ts").alias("sec"), (F.col("event_type") == "error").cast("int").alias("label"))


INCIDENTS = "SELECT 'dev-' || user_id AS ip, ts AS time FROM events WHERE event_type = 'error'"


def incidents(spark: SparkSession, sf: str, key: str = "ip") -> DataFrame:
    e = table(spark, sf, "events").filter("event_type = 'error'")
    return e.select(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias(key), F.col("ts").alias("time"))


# ---- syslog lines of several shapes, one per event

LINES = r"""
SELECT event_id, ts AS timestamp, 'dev-' || user_id AS host, CAST(k AS VARCHAR) AS syslog_pri,
  CASE event_type
    WHEN 'click' THEN head || 'sshd[' || cents || ']: %AUTH-3-LOGIN_OK: Accepted login, user op' || k
                      || ' from 10.0.' || k || '.1 port ' || cents || ' at 0x00ff' || lpad(CAST(k AS VARCHAR), 8, '0')
    WHEN 'view' THEN head || 'kernel: link ae' || k || ' changed state; counter=' || cents || ' of 100'
    WHEN 'error' THEN head || 'chassisd: %CHASSISD-2-FPC_DOWN: FPC ' || k || ' down [temp=' || cents
                      || '] 0a:1b:2c:3d:4e:5f on bng-hn-' || k || ' seqno:' || cents
    WHEN 'purchase' THEN head || 'last message repeated ' || cents || ' times'
    ELSE 'unframed text ' || k || ' -- see http://nms.example.com/e?id=' || cents || ', thanks' END AS message
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
             CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents,
             '<' || (event_id % 191) || '>' || strftime(ts, '%b %d %H:%M:%S') || ' dev-' || user_id || ' ' AS head
      FROM events)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    e = spread(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"), "event_id", 200_000)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").cast("string")
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    host = F.concat(F.lit("dev-"), F.col("user_id").cast("string"))
    head = F.concat(F.lit("<"), F.pmod("event_id", F.lit(191)).cast("string"), F.lit(">"),
                    F.date_format(F.col("ts"), "MMM dd HH:mm:ss"), F.lit(" "), host, F.lit(" "))

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    kind = F.col("event_type")
    message = (
        F.when(kind == "click", text(head, "sshd[", cents, "]: %AUTH-3-LOGIN_OK: Accepted login, user op", k,
                                     " from 10.0.", k, ".1 port ", cents, " at 0x00ff", F.lpad(k, 8, "0")))
        .when(kind == "view", text(head, "kernel: link ae", k, " changed state; counter=", cents, " of 100"))
        .when(kind == "error", text(head, "chassisd: %CHASSISD-2-FPC_DOWN: FPC ", k, " down [temp=", cents,
                                    "] 0a:1b:2c:3d:4e:5f on bng-hn-", k, " seqno:", cents))
        .when(kind == "purchase", text(head, "last message repeated ", cents, " times"))
        .otherwise(text("unframed text ", k, " -- see http://nms.example.com/e?id=", cents, ", thanks")))
    return e.select("event_id", F.col("ts").alias("timestamp"), host.alias("host"), k.alias("syslog_pri"),
                    message.alias("message"))


# ---- document lines as log messages

DOC_LINES = """
SELECT doc_id, source, i - 1 AS line, parts[i] AS message
FROM (SELECT doc_id, source, parts, unnest(generate_series(1, len(parts))) AS i
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents))
WHERE parts[i] <> ''
"""


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", 20_000)
    return (d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "message"))
            .filter(F.col("message") != ""))


def doc_tokens(spark: SparkSession, sf: str, delimiters=()) -> DataFrame:
    rows = doc_lines(spark, sf)
    return rows.select("doc_id", "line", "source", "message", tokens_of(F.col("message"), delimiters).alias("tokens"))


# ---- labels as predictions: toxic is the truth, quality and a hash of the id make a score

SCORED = """
SELECT doc_id, toxic AS y_true,
       CAST(quality * 500 + (doc_id * 7919) % 499 AS DOUBLE) / 1000 AS y_proba
FROM labels
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("y_true"),
        ((F.col("quality") * 500 + F.pmod(F.col("doc_id") * 7919, F.lit(499))).cast("double") / 1000).alias("y_proba"))


# ---- 5-minute windows per device

WINDOWS = """
SELECT ip, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS window_5min_end,
       arg_max(event_type, ROW(timestamp, event_id)) AS last_type, max(label) AS seen
FROM device GROUP BY ALL
"""

# ---- log-key events: event types as tokens

EVENT_CODES = {"click": 5, "error": 6, "purchase": 7, "signup": 8, "view": 9}


def key_events(spark: SparkSession, sf: str) -> DataFrame:
    d = device(spark, sf)
    code = F.create_map(*[F.lit(x) for kv in EVENT_CODES.items() for x in kv])[F.col("event_type")]
    return d.select("event_id", "ip", "timestamp", code.alias("log_key"), "label",
                    (F.regexp_extract("ip", "([0-9]+)", 1).cast("int") + 2).alias("device_id"))


KEY_EVENTS = """
SELECT event_id, 'dev-' || user_id AS ip, ts AS timestamp, CAST(epoch_us(ts) AS BIGINT) AS us,
       CASE event_type WHEN 'click' THEN 5 WHEN 'error' THEN 6 WHEN 'purchase' THEN 7
                       WHEN 'signup' THEN 8 ELSE 9 END AS log_key,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, CAST(user_id AS INT) + 2 AS device_id
FROM events
"""


def with_views(sql: str, **views: str) -> str:
    """SQL with the named views in front."""
    return "WITH " + ",\n".join(f"{n} AS ({v})" for n, v in views.items()) + "\n" + sql
