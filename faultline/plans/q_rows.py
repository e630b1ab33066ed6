"""Queries of row filters, columns and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import clock, columns, text
from faultline.operators import filters
from faultline.plans import stand_ins
from faultline.plans.q_sources import _CHECKS, checks
from faultline.plans.registry import query, table
from faultline.plans.stand_ins import DEVICE, DOC_LINES, LINES, with_views


@query("p1_keep_entities", """
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(spark, sf):
    allow = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    return filters.keep_entities(table(spark, sf, "events").select("event_id", "user_id"), allow, "user_id", "c_custkey")


@query("p2_component_filter", with_views("""
SELECT ip, time, component_name FROM checks WHERE service_name = 'check_juniper_component'
  AND (lower(component_name) LIKE '%fpc%' OR lower(component_name) LIKE '%routing engine%')""",
                                         device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    out = filters.component_filter(checks(spark, sf), "check_juniper_component")
    return out.select(F.col("ip-address").alias("ip"), F.col("@timestamp").alias("time"), "component_name")


@query("p2_interface_filter", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND starts_with(p_name, 'small')")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return filters.interface_filter(p, "Brand#2", "p_name", "p_brand", "small").drop("p_brand")


@query("p3_down_labels", with_views("""
SELECT DISTINCT ip AS ip_address, time, 'DOWN' AS agg_status FROM checks
WHERE TRY_CAST(state AS BIGINT) NOT IN (2, 7)""", device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    return filters.down_labels(checks(spark, sf), "ip-address", "@timestamp", "state")


@query("p4_to_numeric", with_views("""
SELECT ip, time, CAST(TRY_CAST(state AS FLOAT) AS DOUBLE) AS state FROM checks""", device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    c = checks(spark, sf).select(F.col("ip-address").alias("ip"), F.col("@timestamp").alias("time"), "state")
    return columns.to_numeric(c, ["state"]).withColumn("state", F.col("state").cast("double"))


@query("p5_parse_localize", """
SELECT event_id, date_trunc('second', ts) - INTERVAL 7 HOUR AS utc,
       strftime(date_trunc('second', ts) + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S') AS local_text FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("utc"))
    parsed = clock.parse_ts(raw, "utc", "yyyy-MM-dd HH:mm:ss").withColumn("utc", F.col("utc").cast("timestamp_ntz"))
    out = clock.local_text(parsed, "utc", "Asia/Ho_Chi_Minh", "local_text")
    return clock.localize(out, "utc", "Asia/Ho_Chi_Minh")


@query("p6_normalize_component", with_views("""
SELECT ip, time, CASE WHEN component_name = 'Routing Engine' THEN 'Routing Engine 0'
  WHEN lower(component_name) LIKE '%fpc%' THEN 'FPC ' || regexp_extract(component_name, '@ (\\d+)', 1)
  ELSE component_name END AS label FROM checks""", device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    c = checks(spark, sf).select(F.col("ip-address").alias("ip"), F.col("@timestamp").alias("time"), "component_name")
    return columns.normalize_component(c, out="label").drop("component_name")


@query("p7_time_bounds", """
SELECT event_id FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 20 MINUTE""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return filters.time_bounds(e, "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00", "20 minutes").select("event_id")


@query("p8_drop_invalid", with_views("SELECT ip, time, state FROM checks WHERE state IS NOT NULL",
                                     device=DEVICE, checks=_CHECKS))
def _(spark, sf):
    c = checks(spark, sf).select(F.col("ip-address").alias("ip"), F.col("@timestamp").alias("time"), "state")
    return filters.drop_invalid(c, ["state", "time"])


@query("p9_distinct_rows", """
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return filters.distinct_rows(e, ["user_id", "event_type"], ["event_id"])


@query("p10_narrow_types", """
SELECT l_orderkey, l_linenumber, l_suppkey, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS l_quantity FROM lineitem""")
def _(spark, sf):
    return columns.narrow_types(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))


@query("p11_align_columns", """
SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(NULL AS DOUBLE) AS cpu, CAST(NULL AS VARCHAR) AS fpc_state
FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    return columns.align_columns(e, ["event_id", "cpu"], ["user_id", "fpc_state"])


@query("p12_column_roles", """
SELECT 'exclude' AS role, 'event_id' AS col, count(event_id) AS filled, count(DISTINCT event_id) AS kinds FROM events
UNION ALL SELECT 'exclude', 'ts', count(ts), count(DISTINCT ts) FROM events
UNION ALL SELECT 'numeric', 'user_id', count(user_id), count(DISTINCT user_id) FROM events
UNION ALL SELECT 'numeric', 'value', count(value), count(DISTINCT value) FROM events
UNION ALL SELECT 'categorical', 'event_type', count(event_type), count(DISTINCT event_type) FROM events
UNION ALL SELECT 'text', 'props', count(props), count(DISTINCT props) FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events")
    roles = columns.column_roles(e, ["event_id", "ts"], ["props"])
    cells = e.select(F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(c).alias("col"), F.col(c).cast("string").alias("v"))
        for role, cols in roles.items() for c in cols])).alias("_c")).select("_c.*")
    return cells.groupBy("role", "col").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("kinds"))


_SPLIT = """
SELECT 'train' AS part, count(*) AS n, max(event_id) AS last_id FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-21'
UNION ALL SELECT 'test', count(*), max(event_id) FROM events
WHERE ts > TIMESTAMP '2024-01-21' AND ts <= TIMESTAMP '2024-01-28'"""


def _parts(a, b):
    def one(df, name):
        return df.agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).select(F.lit(name).alias("part"), "n", "last_id")

    return one(a, "train").unionByName(one(b, "test"))


@query("p13_chrono_split", _SPLIT)
def _(spark, sf):
    return _parts(*filters.chrono_split(table(spark, sf, "events"), "ts", "2024-01-02", "2024-01-21", "2024-01-28"))


@query("p14_ratio_split", """
WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
SELECT 'train' AS part, count(*) AS n, max(event_id) AS last_id FROM r WHERE rn < CAST(floor(n * 0.7) AS BIGINT)
UNION ALL SELECT 'test', count(*), max(event_id) FROM r WHERE rn >= CAST(floor(n * 0.7) AS BIGINT)""")
def _(spark, sf):
    return _parts(*filters.ratio_split(table(spark, sf, "events").select("event_id", "ts"), "ts", 0.7, "event_id"))


@query("p15_exclude_entities", """
SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def _(spark, sf):
    deny = table(spark, sf, "customer").filter("c_acctbal < 0")
    return filters.exclude_entities(table(spark, sf, "events").select("event_id", "user_id"), deny, "user_id", "c_custkey")


@query("w1_window_end", """
SELECT event_id, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_5min_end,
       CAST(ts AS DATE) + ((CAST(floor((hour(ts) * 60 + minute(ts)) / 7) AS INT) * 7 + 7) * INTERVAL 1 MINUTE) AS window_7min_end
FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return clock.with_window_end(clock.with_window_end(e, "ts", 5), "ts", 7).drop("ts")


@query("w10_ceil_ts", """
SELECT event_id, CAST(ceil(epoch_us(ts) / 300000000.0) AS BIGINT) * 300 AS ceil_ts FROM events""")
def _(spark, sf):
    return clock.with_ceil_ts(table(spark, sf, "events").select("event_id", "ts"), "ts", 300).drop("ts")


# ---- text


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def shape_sql(group) -> str:
    cases = " ".join(f"WHEN regexp_matches(message, {_sql_text(rx)}) "
                     f"THEN regexp_extract(message, {_sql_text(rx)}, {1 if group == 'ts' else g})"
                     for rx, g in text.SYSLOG_SHAPES)
    return f"CASE {cases} END"


_PARSED = f"""
SELECT event_id, {shape_sql('ts')} AS device_time, {shape_sql('msg')} AS message FROM lines"""


@query("t1_parse_syslog", with_views("SELECT * FROM parsed WHERE device_time IS NOT NULL", lines=LINES, parsed=_PARSED))
def _(spark, sf):
    return text.parse_syslog(stand_ins.lines(spark, sf)).select("event_id", "device_time", "message")


def clean_sql(c: str) -> str:
    """The clean-up rules for an engine without look-ahead: a lone 100 steps aside while long numbers go."""
    for rx, to in text.CLEANUPS:
        if "(?!100" in rx:
            c = f"regexp_replace({c}, '\\b100\\b', '\u24d7', 'g')"
            c = f"regexp_replace({c}, '\\b\\d{{3,}}\\b', '', 'g')"
            c = f"replace({c}, '\u24d7', '100')"
        else:
            c = f"regexp_replace({c}, {_sql_text(rx)}, {_sql_text(to)}, 'g')"
    return f"lower(trim({c}))"


@query("t2_clean_message", with_views(f"SELECT event_id, {clean_sql('message')} AS clean FROM lines", lines=LINES))
def _(spark, sf):
    return text.clean_message(stand_ins.lines(spark, sf), out="clean").select("event_id", "clean")


@query("t2_clean_documents")
def _(spark, sf):
    return text.clean_message(stand_ins.doc_lines(spark, sf), out="clean").select("doc_id", "line", "clean")


# the production rules without look-around, for lines where that makes no difference
# fixed values: the masking rules for an engine without look-around
_MASKS_SQL = [
    (r"\[\d+\]", "<<PID>>"), (r"( command )('[^']+')", r"\1<<CMD>>"),
    (r"(?i)( )user\s*(?:([a-zA-Z0-9_\-]+)|=([a-zA-Z0-9_\-]+)|'([^']+)')", r"\1<<USER>>"),
    (r"([A-Z][a-z]{2} +\d{1,2} +\d{2}):(\d{2}:\d{2})", "<<TIME>>"),
    (r"([ <])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}([^:\w]|$)", r"\1<<MAC_ADD>>\2"), (r"seqno:\d+", "<<SEQ>>"),
    (r"([^A-Za-z0-9]|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})([^A-Za-z0-9]|$)", r"\1<<IPV4>>\3"),
    (r"(?:[A-Za-z0-9]{2,15}-){2,}[A-Za-z0-9]+(\s)", r"<<DEVICE>>\1"),
    (text.MASK_RULES[8][0].replace(r"(?=\s|,|\/|$)", r"(\s|,|\/|$)"), r"<<IPv6>>\1"),
    (r"0x[0-9a-fA-F]{8,16}", "<<MEMORY_ADD>>"), (r"([\s=:])[0-9]\d*\b", r"\1<<NUM>>"),
    (r"https?://[^\s,\"]+", "<<URL>>"),
]


def _mask_sql(c: str) -> str:
    for rx, to in _MASKS_SQL:
        c = f"regexp_replace({c}, {_sql_text(rx)}, {_sql_text(to)}, 'g')"
    return c


@query("t3_mask_messages", with_views(f"SELECT event_id, {_mask_sql('message')} AS masked FROM lines", lines=LINES))
def _(spark, sf):
    return text.mask_messages(stand_ins.lines(spark, sf), out="masked").select("event_id", "masked")


@query("t3_mask_documents")
def _(spark, sf):
    return text.mask_messages(stand_ins.doc_lines(spark, sf), out="masked").select("doc_id", "line", "masked")


_BLANK_SQL = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]+"
_TOKENS_SQL = f"""
SELECT doc_id, line, list_filter(regexp_split_to_array(translate(message, '=:', '  '), {_sql_text(_BLANK_SQL)}),
                                 lambda t: t <> '') AS tokens FROM doc_lines"""


@query("t4_tokenize", with_views("SELECT doc_id, line, array_to_string(tokens, '|') AS tokens, len(tokens) AS n FROM toks",
                                 doc_lines=DOC_LINES, toks=_TOKENS_SQL))
def _(spark, sf):
    rows = text.tokenize(stand_ins.doc_lines(spark, sf), delimiters=["=", ":"])
    return rows.select("doc_id", "line", F.array_join("tokens", "|").alias("tokens"), text.token_count().alias("n"))


@query("t5_token_count", with_views("SELECT n, count(*) AS rows FROM (SELECT len(tokens) AS n FROM toks) GROUP BY n",
                                    doc_lines=DOC_LINES, toks=_TOKENS_SQL))
def _(spark, sf):
    rows = text.tokenize(stand_ins.doc_lines(spark, sf), delimiters=["=", ":"])
    return rows.groupBy(text.token_count().alias("n")).agg(F.count("*").alias("rows"))


@query("t6_strip_header", with_views("""
SELECT event_id, CASE WHEN strpos(message, ': ') > 0 THEN substr(message, strpos(message, ': ') + 2) ELSE '' END AS body
FROM lines""", lines=LINES))
def _(spark, sf):
    return text.strip_header(stand_ins.lines(spark, sf), "message", out="body").select("event_id", "body")
