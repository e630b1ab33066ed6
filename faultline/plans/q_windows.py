"""Queries of rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import rolling
from faultline.plans import stand_ins
from faultline.plans.registry import query
from faultline.plans.stand_ins import DEVICE, with_views


def _over(lo: int, hi: int = 0) -> str:
    top = "CURRENT ROW" if hi == 0 else f"{-hi} PRECEDING"
    return f"OVER (PARTITION BY ip ORDER BY sec RANGE BETWEEN {-lo} PRECEDING AND {top})"


_SPANS = (900, 1800, 3600)
_ROLL = ",\n".join(
    f"round(avg(value) {_over(-w)}, 6) AS value_avg_{w}, round(stddev_samp(value) {_over(-w)}, 6) AS value_std_{w}, "
    f"round((avg(value) {_over(-w)} - avg(value) {_over(-2 * w, -w)}) / nullif(avg(value) {_over(-2 * w, -w)}, 0), 6) "
    f"AS value_pct_change_{w}" for w in _SPANS)


@query("w2_w3_rolling", with_views(f"SELECT event_id, {_ROLL} FROM device", device=DEVICE))
def _(spark, sf):
    out = rolling.rolling_avg_std(stand_ins.device(spark, sf), ["value"], _SPANS, ["ip"], "sec")
    names = [f"value_{what}_{w}" for w in _SPANS for what in ("avg", "std", "pct_change")]
    return out.select("event_id", *[F.round(n, 6).alias(n) for n in names])


_COUNTS = ", ".join(f"round(count(*) {_over(-d)} / nullif(count(*) {_over(-2 * d, -d)}, 0), 6) "
                    f"AS ratio_countlog_delta_{d // 60}min" for d in (1800, 2700))


@query("w4_log_count_ratio", with_views(f"SELECT event_id, {_COUNTS} FROM device", device=DEVICE))
def _(spark, sf):
    out = rolling.log_count_ratio(stand_ins.device(spark, sf), keys=["ip"], sec="sec")
    names = ["ratio_countlog_delta_30min", "ratio_countlog_delta_45min"]
    return out.select("event_id", *[F.round(n, 6).alias(n) for n in names])


@query("w5_priority_ratio", with_views(f"""
SELECT event_id, round(avg(k) {_over(-900)}, 6) AS now,
  round(avg(k) {_over(-900)} / nullif(avg(k) {_over(-1800)}, 0), 6) AS vs30,
  round(avg(k) {_over(-900)} / nullif(avg(k) {_over(-3600)}, 0), 6) AS vs60 FROM device""", device=DEVICE))
def _(spark, sf):
    d = stand_ins.device(spark, sf).withColumn("priority_score", F.col("k").cast("double"))
    out = rolling.priority_ratio(d, keys=["ip"], sec="sec")
    return out.select("event_id", F.round("avg_pri_score_prev_15m", 6).alias("now"),
                      F.round("ratio_pri_score_prev_15m_vs_30m", 6).alias("vs30"),
                      F.round("ratio_pri_score_prev_15m_vs_60m", 6).alias("vs60"))


def _mode_sql(lo: int, hi: int) -> str:
    return (f"(SELECT event_type FROM device x WHERE x.ip = d.ip AND x.sec BETWEEN d.sec - {lo} AND d.sec - {hi} "
            "GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)")


@query("w6_state_mode", with_views(
    f"""SELECT event_id, {_mode_sql(1800, 0)} AS last, {_mode_sql(3600, 1800)} AS second_last FROM device d""",
    device=DEVICE))
def _(spark, sf):
    out = rolling.state_mode(stand_ins.device(spark, sf), ["event_type"], ["ip"], "sec")
    return out.select("event_id", F.col("event_type_mode_last_30min").alias("last"),
                      F.col("event_type_mode_2nd_last_30min").alias("second_last"))
