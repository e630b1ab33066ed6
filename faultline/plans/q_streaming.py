"""Queries of the streaming jobs (R1-R6), run over what is there now."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions.text import MASK_DELIMITERS, tokens_of
from faultline.operators.mining_core import MinerConfig
from faultline.plans.q_joins import _WIN, _labelled
from faultline.operators.templates import mine_templates
from faultline.plans import stand_ins
from faultline.plans.q_templates import _DOC_TOKENS
from faultline.plans.registry import query, table
from faultline.plans.stand_ins import DEVICE, DOC_LINES, INCIDENTS, with_views
from faultline.streaming import jobs


def _files(spark, sf, name, files_per_trigger=None):
    """A table as a stream of its files, be it one file or a folder of them. A pattern as path allows both."""
    return jobs.stream_incremental_files(spark, f"{sf}/{name}.parque[t]", table(spark, sf, name).schema,
                                         files_per_trigger=files_per_trigger)


def _events(spark, sf):
    """The events as a stream, times as instants."""
    raw = _files(spark, sf, "events")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("timestamp"),
                      F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("host"), "event_type",
                      F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("priority_score"))


# a window is written once the watermark (latest time minus the delay) has passed its end
_CLOSED = "<= (SELECT max(timestamp) FROM device) - INTERVAL 10 MINUTE"


def _naive(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("r1_stream_window_features", with_views(f"""
SELECT ip AS host, w AS window_5min_end, count(*) AS n,
  round(avg(k), 6) AS avg_pri, string_agg(event_type, ' ' ORDER BY timestamp, event_type) AS combined_message
FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, timestamp) + INTERVAL 5 MINUTE AS w FROM device)
WHERE w {_CLOSED} GROUP BY ip, w""", device=DEVICE))
def _(spark, sf):
    out = jobs.run_available(jobs.stream_window_features(_events(spark, sf), msg="event_type"), "r1")
    return _naive(out, "window_5min_end").withColumn("avg_pri", F.round("avg_pri", 6))


@query("r2_stream_hopping", with_views(f"""
SELECT ip AS host, w + INTERVAL 15 MINUTE AS window_end, count(*) AS n
FROM (SELECT ip, unnest(list_transform([0, 1, 2], lambda i: time_bucket(INTERVAL 5 MINUTE, timestamp) - i * INTERVAL 5 MINUTE)) AS w FROM device)
GROUP BY ALL HAVING window_end {_CLOSED}""", device=DEVICE))
def _(spark, sf):
    return _naive(jobs.run_available(jobs.stream_hopping(_events(spark, sf)), "r2"), "window_end")


# the outer join holds a window until no incident can reach it, behind the slower watermark of the two
@query("r3_stream_label", with_views("""
SELECT ip_address, window_5min_end, label FROM lab
WHERE window_5min_end <= (SELECT max(time) FROM inc) - INTERVAL 10 MINUTE - INTERVAL 1201 SECOND""",
                                     device=DEVICE, inc=INCIDENTS, win=_WIN, lab=_labelled("win")))
def _(spark, sf):
    e = _events(spark, sf)
    windows = (e.withWatermark("timestamp", "10 minutes").groupBy("host", F.window("timestamp", "5 minutes"))
               .agg(F.count("*").alias("n"))
               .select(F.col("host").alias("ip_address"), F.window_time("window").alias("window_5min_end")))
    inc = _events(spark, sf).filter("event_type = 'error'").select(F.col("host").alias("ip_address"), F.col("timestamp").alias("time"))
    return _naive(jobs.run_available(jobs.stream_label(windows, inc), "r3"), "window_5min_end")


def _document_lines(spark, sf):
    docs = _files(spark, sf, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "message")).filter("message <> ''")
    return lines.select("doc_id", "line", tokens_of(F.col("message"), MASK_DELIMITERS).alias("tokens"))


@query("r4_stream_mine_templates")
def _(spark, sf):
    out = jobs.stream_mine_templates(_document_lines(spark, sf), "tokens", ["doc_id", "line"], MinerConfig())
    return out.select("doc_id", "line", "shard", "cluster_id", "change_type", "cluster_size", "template_mined")


@query("r4_stream_equals_batch", with_views("SELECT doc_id, line, true AS same FROM toks", doc_lines=DOC_LINES, toks=_DOC_TOKENS))
def _(spark, sf):
    """One micro-batch gives every line the cluster, change and template that mining in one run gives it."""
    order, told = ["doc_id", "line"], ["cluster_id", "change_type", "cluster_size", "template_mined"]
    stream = jobs.stream_mine_templates(_document_lines(spark, sf), "tokens", order, MinerConfig())
    batch = mine_templates(stand_ins.doc_tokens(spark, sf, MASK_DELIMITERS), "tokens", order, MinerConfig())[0]
    both = batch.select(*order, F.struct(*told).alias("_a")).join(
        stream.select(*order, F.struct(*told).alias("_b")), order, "full")
    return both.select(*order, F.col("_a").eqNullSafe(F.col("_b")).alias("same"))


@query("r5_stream_upsert", """
SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def _(spark, sf):
    e = table(spark, sf, "events")
    base = e.filter("event_type <> 'signup'").groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    updates = _files(spark, sf, "events").select(
        "user_id", "event_type", "value", F.col("event_id").alias("seq"))
    return jobs.stream_upsert(updates, base, ["user_id", "event_type"], "seq")


@query("r6_stream_incremental_files", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    out = _files(spark, sf, "events", files_per_trigger=1)
    return jobs.run_available(out.select("event_id", "user_id", "event_type"), "r6")
