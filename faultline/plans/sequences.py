"""The sequence job: log lines to labelled token sequences per device."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import MASK_DELIMITERS, mask_text, tokens_of
from faultline.operators import joins, vocab
from faultline.operators.mining_core import MinerConfig
from faultline.operators.sequences import hopping_sequences
from faultline.operators.templates import map_templates

# fixed values: the production miner
PRODUCTION = MinerConfig(sim_th=0.8, depth=4, max_children=100, max_clusters=16384)


def masked_tokens(df: DataFrame, message: str = "message", out: str = "tokens") -> DataFrame:
    """Mask a message by the production rules and cut it into tokens."""
    return df.withColumn(out, tokens_of(mask_text(F.col(message)), MASK_DELIMITERS))


def keyed_events(lines: DataFrame, incidents: DataFrame, catalog: DataFrame, templates: DataFrame,
                 devices: DataFrame, cfg: MinerConfig = PRODUCTION, strategy: str = "never") -> DataFrame:
    """(event_id, ip, timestamp, label, log_key, device_id): as-of label, template id and device id of every line.

    Lines that have ``tokens`` already, those of :func:`masked_tokens`, are not masked again.
    """
    rows = lines.filter(F.col("message").isNotNull())
    rows = (rows if "tokens" in rows.columns else masked_tokens(rows)).select("event_id", "ip", "timestamp", "tokens")
    rows = map_templates(joins.label_asof(rows, incidents), "tokens", catalog, strategy, cfg, vocab=templates)
    rows = joins.lookup_vocab(rows, devices, "ip", out="device_id", unk=vocab.UNK)
    return rows.select("event_id", "ip", "timestamp", "label", "log_key", "device_id")


def device_sequences(events: DataFrame, width: float = 15, slice_hours: int | None = None) -> DataFrame:
    """Hopping sequences of all devices. ``slice_hours`` keeps windows inside fixed slices of the day."""
    if slice_hours is None:
        return hopping_sequences(events, width=width)
    day = F.date_format("timestamp", "yyyy-MM-dd")
    part = F.concat_ws("-", day, F.floor(F.hour("timestamp") / slice_hours).cast("string"))
    return hopping_sequences(events.withColumn("slice", part), width=width, extra=["slice"])
