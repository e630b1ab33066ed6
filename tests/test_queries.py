"""The contract, and one registered query per family against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
FAMILIES = ["s5_normalize_schema", "s12_upsert", "s16_harmonize_labels", "t1_parse_syslog", "t3_mask_messages", "t4_tokenize",
            "j1_label_future_any_end", "j2_label_asof", "a4_first_non_null_merge", "a11_trailing_active", "w2_w3_rolling",
            "w6_state_mode", "w8_hopping_slices", "v5_encode", "v10_segment_mean", "g4_pr_auc", "f1_tfidf", "m7_match_never",
            "o3_deal_to_workers", "syslog_device_windows", "r2_stream_hopping"]

needs_data = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.rows > 0 and 0 <= row.positive_rate <= 1


@needs_data
@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_sql(spark, name):
    ok, note, _rows, _took = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, note


def test_training_windows_are_made_once(spark):
    """What every fit and every pass over the training rows reads is settled, not the events again."""
    from faultline.plans.q_evaluate import _training

    assert "FileScan" not in _training(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
