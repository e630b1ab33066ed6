"""Queries of labels, joins and aggregations (J1-J6, A1-A11, A16) and of the flagship job."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.clock import with_window_end
from faultline.operators import aggregates as agg
from faultline.operators import joins
from faultline.plans import stand_ins, tabular
from faultline.plans.q_rows import clean_sql, shape_sql
from faultline.plans.registry import query, table
from faultline.plans.stand_ins import DEVICE, INCIDENTS, LINES, with_views

_END = "time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE"
_WIN = f"SELECT ip AS ip_address, {_END} AS window_5min_end, count(*) AS n FROM device GROUP BY ALL"


def _windows(spark, sf):
    rows = with_window_end(stand_ins.device(spark, sf).withColumnRenamed("ip", "ip_address"), "timestamp", 5)
    return rows.groupBy("ip_address", "window_5min_end").agg(F.count("*").alias("n"))


def _labelled(windows: str) -> str:
    """J1 word by word: pairs, near hits out, the rest labelled by whether they matched."""
    return f"""
SELECT DISTINCT w.*, CASE WHEN i.ip IS NOT NULL THEN 1 ELSE 0 END AS label
FROM {windows} w LEFT JOIN inc i ON i.ip = w.ip_address
  AND i.time BETWEEN w.window_5min_end AND w.window_5min_end + INTERVAL 20 MINUTE
WHERE i.ip IS NULL OR floor(epoch(i.time)) - floor(epoch(w.window_5min_end)) >= 300"""


@query("j1_label_future_windows", with_views(_labelled("win"), device=DEVICE, inc=INCIDENTS, win=_WIN))
def _(spark, sf):
    return joins.label_future_windows(_windows(spark, sf), stand_ins.incidents(spark, sf, "ip_address"), grid=300)


@query("j1_label_future_any_end", with_views(
    _labelled("ends").replace("w.*", "w.ip_address, w.window_5min_end, w.event_id"), device=DEVICE, inc=INCIDENTS,
    ends="SELECT ip AS ip_address, date_trunc('second', timestamp) AS window_5min_end, event_id FROM device"))
def _(spark, sf):
    ends = stand_ins.device(spark, sf).select(
        F.col("ip").alias("ip_address"), F.date_trunc("second", "timestamp").cast("timestamp_ntz").alias("window_5min_end"),
        "event_id")
    return joins.label_future_windows(ends, stand_ins.incidents(spark, sf, "ip_address"))


@query("j2_label_asof", with_views("""
SELECT d.event_id, CASE WHEN i.time <= d.timestamp + INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS label
FROM (SELECT *, timestamp + INTERVAL 5 MINUTE AS t5 FROM device) d ASOF LEFT JOIN inc i ON d.ip = i.ip AND d.t5 <= i.time
""", device=DEVICE, inc=INCIDENTS))
def _(spark, sf):
    d = stand_ins.device(spark, sf).select("event_id", "ip", "timestamp")
    return joins.label_asof(d, stand_ins.incidents(spark, sf)).select("event_id", "label")


@query("j3_attach_features", with_views(f"""
SELECT w.*, f.total FROM win w LEFT JOIN (
  SELECT ip AS ip_address, {_END} AS window_5min_end, round(sum(value), 4) AS total FROM device
  WHERE event_type = 'view' GROUP BY ALL) f USING (ip_address, window_5min_end)""", device=DEVICE, win=_WIN))
def _(spark, sf):
    rows = with_window_end(stand_ins.device(spark, sf).withColumnRenamed("ip", "ip_address"), "timestamp", 5)
    feats = rows.filter("event_type = 'view'").groupBy("ip_address", "window_5min_end").agg(
        F.round(F.sum("value"), 4).alias("total"))
    return joins.attach_features(_windows(spark, sf), feats)


@query("j4_map_through", """
SELECT event_id, user_id, event_type, dense_rank() OVER (ORDER BY event_type) AS code FROM events""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    from faultline.operators.order import global_rank

    codes = global_rank(e.select("event_type").distinct(), ["event_type"], name="code").withColumn("code", F.col("code") + 1)
    return joins.map_through(e, "event_type", codes)


@query("j5_lookup_vocab", """
SELECT event_id, coalesce(v.id, 1) AS id FROM events LEFT JOIN (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + 4 AS id FROM customer WHERE c_mktsegment = 'MACHINERY') v
ON user_id = c_custkey""")
def _(spark, sf):
    from faultline.operators.order import global_rank

    vocab = global_rank(table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(
        F.col("c_custkey").alias("token")), ["token"], name="id").withColumn("id", F.col("id") + 5)
    return joins.lookup_vocab(table(spark, sf, "events"), vocab, "user_id").select("event_id", "id")


@query("j6_entity_universe", """
(SELECT CAST(c_custkey AS VARCHAR) AS ip_address FROM customer WHERE c_mktsegment = 'MACHINERY'
 UNION SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)
INTERSECT SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'error'""")
def _(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").cast("string").alias("a"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("b"))
    e = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").cast("string").alias("c"))
    return joins.entity_universe([(c, "a"), (s, "b")], (e, "c"))


# ---- aggregations


@query("a1_last_row_per_window", with_views(f"""
SELECT ip, {_END} AS window_5min_end, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
       max(event_id) AS event_id FROM device GROUP BY ALL""", device=DEVICE))
def _(spark, sf):
    rows = with_window_end(stand_ins.device(spark, sf), "timestamp", 5)
    last = agg.last_row_per_window(rows, ["ip", "window_5min_end"], "timestamp", ["event_id"])
    return last.select("ip", "window_5min_end", "event_type", "value", "event_id")


_PIVOT = ",".join(f"arg_min(l_quantity, tie) FILTER (l_linenumber = {n}) AS \"{n}_quantity\", "
                  f"arg_min(l_tax, tie) FILTER (l_linenumber = {n}) AS \"{n}_tax\""
                  for n in range(1, 8))


@query("a2_pivot_components", f"""
SELECT l_orderkey, {_PIVOT}
FROM (SELECT *, l_extendedprice * 1000000 + l_quantity * 10000 + l_tax * 100 + l_suppkey / 1000000 AS tie FROM lineitem)
GROUP BY l_orderkey""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("string").alias("component"), F.col("l_quantity").alias("quantity"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") * 1000000 + F.col("l_quantity") * 10000 + F.col("l_tax") * 100
         + F.col("l_suppkey") / 1000000).alias("tie"))
    return agg.pivot_components(li, ["l_orderkey"], "component", ["quantity", "tax"], tie="tie")


@query("a4_first_non_null_merge", """
SELECT user_id, a.clicks, b.views, c.last_error FROM
  (SELECT user_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY 1) a
  FULL JOIN (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)
  FULL JOIN (SELECT user_id, max(event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1) c USING (user_id)""")
def _(spark, sf):
    e = table(spark, sf, "events")

    def part(kind, what):
        return e.filter(F.col("event_type") == kind).groupBy("user_id").agg(what)

    return agg.first_non_null_merge([part("click", F.count("*").alias("clicks")), part("view", F.count("*").alias("views")),
                                     part("error", F.max("event_id").alias("last_error"))], ["user_id"])


@query("a5_combine_messages", with_views(f"""
SELECT ip, {_END} AS window_5min_end, lower(string_agg(event_type || ' K' || k, ' ' ORDER BY sec, event_type || ' K' || k))
  AS combined_message FROM device GROUP BY ALL""", device=DEVICE))
def _(spark, sf):
    rows = with_window_end(stand_ins.device(spark, sf), "timestamp", 5).withColumn(
        "msg", F.concat("event_type", F.lit(" K"), F.col("k").cast("string")))
    return agg.combine_messages(rows, ["ip", "window_5min_end"], "sec", "msg")


@query("a6_distinct_set", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    return agg.distinct_set(table(spark, sf, "events"), "user_id")


@query("a7_time_range", "SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM events")
def _(spark, sf):
    return agg.time_range(table(spark, sf, "events"), "ts")


@query("a8_split_stats", with_views("""
SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives, avg(label) AS positive_rate,
       count(DISTINCT ip_address) AS devices FROM lab""",
                                    device=DEVICE, inc=INCIDENTS, win=_WIN, lab=_labelled("win")))
def _(spark, sf):
    return tabular.label_rate(spark, sf)


@query("a9_class_weights", """
SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1,
  count(*) / (2.0 * count(*) FILTER (toxic = 0)) AS weight_0, count(*) / (2.0 * count(*) FILTER (toxic = 1)) AS weight_1,
  count(*) FILTER (toxic = 0) / CAST(count(*) FILTER (toxic = 1) AS DOUBLE) AS neg_pos_ratio FROM labels""")
def _(spark, sf):
    return agg.class_weights(table(spark, sf, "labels"), "toxic")


@query("a10_positive_entities", with_views("""
SELECT event_id FROM device d WHERE EXISTS (SELECT 1 FROM device x WHERE x.label = 1 AND x.ip = d.ip
  AND CAST(x.timestamp AS DATE) = CAST(d.timestamp AS DATE))""", device=DEVICE))
def _(spark, sf):
    d = stand_ins.device(spark, sf).withColumn("day", F.to_date("timestamp"))
    return agg.positive_entities(d, ["ip", "day"]).select("event_id")


@query("a11_trailing_active", with_views("""
SELECT event_id FROM device d WHERE EXISTS (SELECT 1 FROM inc i WHERE i.ip = d.ip
  AND CAST(d.timestamp AS DATE) <= (SELECT max(CAST(time AS DATE)) FROM inc)
  AND i.time >= CAST(d.timestamp AS DATE) - INTERVAL 1 DAY AND i.time <= CAST(d.timestamp AS DATE) + INTERVAL 1 DAY)""",
                                         device=DEVICE, inc=INCIDENTS))
def _(spark, sf):
    active = agg.trailing_active_entities(stand_ins.incidents(spark, sf), "ip", "time", days=2)
    return agg.keep_active(stand_ins.device(spark, sf), active, "ip", "timestamp").select("event_id")


_VALUES = "SELECT vec_id, unnest(embedding) AS v FROM embeddings"


@query("a16_describe_values", f"""
SELECT count(*) AS n, round(sum(abs(v)), 4) AS l1_norm, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean,
  round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75 FROM (SELECT CAST(v AS DOUBLE) AS v FROM ({_VALUES}))""")
def _(spark, sf):
    return _rounded(_values(spark, sf)[0])


def _values(spark, sf):
    flat = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return agg.describe_values(flat, "v", ["vec_id", "pos"], 20)


def _rounded(one):
    return one.withColumns({"l1_norm": F.round("l1_norm", 4), **{c: F.round(c, 6) for c in
                                                                  ("mean", "std", "q25", "q50", "q75")}})


@query("a16_value_histogram", f"""
WITH f AS (SELECT CAST(v AS DOUBLE) AS v FROM ({_VALUES})),
b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 20 AS w, count(*) AS n FROM f)
SELECT CAST(least(floor((v - lo) / w), 19) AS INT) AS bin, count(*) AS obs,
  round(lo + CAST(least(floor((v - lo) / w), 19) AS INT) * w, 6) AS left_edge, round(count(*) / (n * w), 6) AS density
FROM f, b GROUP BY bin, lo, w, n""")
def _(spark, sf):
    return _values(spark, sf)[1].withColumns({"left_edge": F.round("left_edge", 6), "density": F.round("density", 6)})


@query("labelled_device_windows", with_views("""
SELECT l.ip_address, l.window_5min_end, l.n, l.label, round(r30, 6) AS ratio30, round(r45, 6) AS ratio45 FROM lab l
JOIN (SELECT ip AS ip_address, window_5min_end, arg_max_null(r30, sec) AS r30, arg_max_null(r45, sec) AS r45 FROM (
  SELECT ip, sec, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS window_5min_end,
   count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW)
     / nullif(count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 3600 PRECEDING AND 1800 PRECEDING), 0) AS r30,
   count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 2700 PRECEDING AND CURRENT ROW)
     / nullif(count(*) OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN 5400 PRECEDING AND 2700 PRECEDING), 0) AS r45
  FROM device) GROUP BY ALL) USING (ip_address, window_5min_end)""",
                                             device=DEVICE, inc=INCIDENTS, win=_WIN, lab=_labelled("win")))
def _(spark, sf):
    return tabular.device_windows(spark, sf).select(
        "ip_address", "window_5min_end", "n", "label", F.round("ratio_countlog_delta_30min", 6).alias("ratio30"),
        F.round("ratio_countlog_delta_45min", 6).alias("ratio45"))


def _syslog_over(what: str, lo: int, hi: int = 0) -> str:
    top = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    return f"{what} OVER (PARTITION BY host ORDER BY sec RANGE BETWEEN {-lo} PRECEDING AND {top})"


_SYSLOG_ROWS = f"""
SELECT host AS ip_address, {_END} AS window_5min_end, sec, clean,
  round({_syslog_over('count(*)', -1800)} / nullif({_syslog_over('count(*)', -3600, -1800)}, 0), 6) AS r30,
  round({_syslog_over('count(*)', -2700)} / nullif({_syslog_over('count(*)', -5400, -2700)}, 0), 6) AS r45,
  round({_syslog_over('avg(pri)', -900)}, 6) AS p15,
  round({_syslog_over('avg(pri)', -900)} / nullif({_syslog_over('avg(pri)', -1800)}, 0), 6) AS p30,
  round({_syslog_over('avg(pri)', -900)} / nullif({_syslog_over('avg(pri)', -3600)}, 0), 6) AS p60
FROM (SELECT host, timestamp, CAST(floor(epoch(timestamp)) AS BIGINT) AS sec, CAST(syslog_pri AS DOUBLE) AS pri,
             {clean_sql('body')} AS clean
      FROM (SELECT *, {shape_sql('msg')} AS body FROM (SELECT DISTINCT host, timestamp, syslog_pri, message FROM lines))
      WHERE body IS NOT NULL)"""


@query("syslog_device_windows", with_views(_labelled("win"), lines=LINES, inc=INCIDENTS, win=f"""
SELECT ip_address, window_5min_end, arg_max_null(r30, sec) AS r30, arg_max_null(r45, sec) AS r45, arg_max_null(p15, sec) AS p15,
  arg_max_null(p30, sec) AS p30, arg_max_null(p60, sec) AS p60, string_agg(clean, ' ' ORDER BY sec, clean) AS combined_message
FROM ({_SYSLOG_ROWS}) GROUP BY ALL"""))
def _(spark, sf):
    windows = tabular.syslog_windows(stand_ins.lines(spark, sf).drop("event_id"))
    names = {"ratio_countlog_delta_30min": "r30", "ratio_countlog_delta_45min": "r45", "avg_pri_score_prev_15m": "p15",
             "ratio_pri_score_prev_15m_vs_30m": "p30", "ratio_pri_score_prev_15m_vs_60m": "p60"}
    out = tabular.labelled_windows(windows, stand_ins.incidents(spark, sf, "ip_address"))
    return out.withColumnsRenamed(names).withColumns({n: F.round(n, 6) for n in names.values()})


def _component_polls(spark, sf):
    """Every event as one poll of a component, a subscriber check or an interface."""
    from faultline.sources.readers import normalize_schema

    d = stand_ins.device(spark, sf)
    k, cents = F.col("k").cast("string"), F.round(F.col("value") * 100).cast("bigint").cast("string")
    kind = F.col("event_type")
    service = (F.when(kind.isin("click", "view"), tabular.COMPONENT_SERVICE).when(kind == "purchase", tabular.SUBSCRIBER_SERVICE)
               .otherwise(tabular.TRAFFIC_SERVICE))
    comp = F.when(F.col("k") % 2 == 0, "Routing Engine").otherwise(F.concat(F.lit("FPC: slot @ "), (F.col("k") % 3).cast("string")))
    value = F.to_json(F.struct(*[cents.alias(c) for c in ("cpu", "heap", "temp", "jnx_subscriber_active_count",
                                                          "jnx_subscriber_total_count", "if_out_octets", "if_in_octets")],
                               (F.col("k") % 5).cast("string").alias("state")))
    return normalize_schema(d.select(
        F.col("event_id").cast("string").alias("job_id"), F.col("ip").alias("ip-address"), comp.alias("component_name"),
        F.concat(F.lit("et-"), k).alias("if_name"), value.alias("value"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("time"), service.alias("service_name")))


@query("poll_device_windows")
def _(spark, sf):
    devices = table(spark, sf, "events").select(
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("ip_address")).distinct()
    return tabular.poll_windows(_component_polls(spark, sf), devices, ["FPC 0", "FPC 1", "FPC 2", "Routing Engine 0"])


_POLLS = """
SELECT event_id, ip, event_type, k, sec, date_trunc('second', timestamp) AS t,
  time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS w, CAST(CAST(round(value * 100) AS BIGINT) AS DOUBLE) AS v
FROM device"""


def _poll_over(lo: int, hi: int = 0) -> str:
    top = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    return f"OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN {-lo} PRECEDING AND {top})"


@query("poll_window_columns", with_views(f"""
SELECT coalesce(c.ip, s.ip, t.ip) AS ip_address, coalesce(c.w, s.w, t.w) AS window_5min_end, fpc1_cpu, re_state, active,
       octets, avg_900, std_900, change_900
FROM (SELECT ip, w, arg_max(CASE WHEN k % 2 = 1 AND k % 3 = 1 THEN v ELSE -1 END, sec) AS fpc1_cpu,
             arg_max(CASE WHEN k % 2 = 0 THEN CAST(k % 5 AS VARCHAR) ELSE 'none' END, sec) AS re_state
      FROM polls WHERE event_type IN ('click', 'view') GROUP BY ALL) c
FULL JOIN (SELECT ip, w, arg_max(v, sec) AS active FROM polls WHERE event_type = 'purchase' GROUP BY ALL) s
  ON c.ip = s.ip AND c.w = s.w
FULL JOIN (SELECT ip, w, arg_max(v, sec) AS octets, round(arg_max(a, sec), 6) AS avg_900, round(arg_max(d, sec), 6) AS std_900,
             round(arg_max(coalesce((a - b) / nullif(b, 0), -9), sec), 6) AS change_900
           FROM (SELECT *, avg(v) {_poll_over(-900)} AS a, coalesce(stddev_samp(v) {_poll_over(-900)}, -1) AS d,
                   avg(v) {_poll_over(-1800, -900)} AS b FROM polls WHERE event_type IN ('signup', 'error')) GROUP BY ALL) t
  ON t.ip = coalesce(c.ip, s.ip) AND t.w = coalesce(c.w, s.w)""", device=DEVICE, polls=_POLLS))
def _(spark, sf):
    """Columns of all three poll frames; gaps inside a frame get a mark, so that they differ from an absent frame."""
    devices = stand_ins.device(spark, sf).select(F.col("ip").alias("ip_address"))
    wide = tabular.poll_windows(_component_polls(spark, sf), devices, ["FPC 0", "FPC 1", "FPC 2", "Routing Engine 0"])
    comp = F.coalesce(*[F.col(f"`{c}_cpu`") for c in ("FPC 0", "FPC 1", "FPC 2", "Routing Engine 0")]).isNotNull()
    traffic = F.col("if_out_octets").isNotNull()
    return wide.select(
        "ip_address", F.col("window_5min_end").cast("timestamp_ntz").alias("window_5min_end"),
        F.when(comp, F.coalesce(F.col("`FPC 1_cpu`").cast("double"), F.lit(-1.0))).alias("fpc1_cpu"),
        F.when(comp, F.coalesce(F.col("`Routing Engine 0_state`"), F.lit("none"))).alias("re_state"),
        F.col("jnx_subscriber_active_count").cast("double").alias("active"), F.col("if_out_octets").cast("double").alias("octets"),
        F.round("if_out_octets_avg_900", 6).alias("avg_900"),
        F.when(traffic, F.coalesce(F.round("if_out_octets_std_900", 6), F.lit(-1.0))).alias("std_900"),
        F.when(traffic, F.coalesce(F.round("if_out_octets_pct_change_900", 6), F.lit(-9.0))).alias("change_900"))
