"""Registered queries against their independent SQL on the same tables.

A sample of every family runs by default; ``CHRONOWEAVE_FULL=1`` runs them all.
"""

import os

import pytest
from check import compare, connect

from __spark_entry__ import oracle_sql, queries

SAMPLE = """flagship_ranked_board a2_vtt_blocks_to_cues a6_monotonic_filter a13_replace_partition b5_rolling_overlap b7_expand_phrases b17_hashtag_line b21_quote_in_note
c1_segment_sentences c2_overlap_chunks c9_locate_phrase_fuzzy c16_interval_nms c23_mining_invariants d3_group_captions d9_word_overrides d14_snap_cues e1_merge_intervals e4_exclusive_order
e8_source_to_output e14_intersect_spans e23_nearest_snap f10_rolling_mean f13_hysteresis_switch f15_ema f21_interpolate_asof f26_decimate_keep_jumps g2_catalog_search g13_default_chain h8_usage_rollup h12_batch_keys
i1_orphan_objects i5_media_fragments j4_crowded_scopes j12_undo_apply k3_stage_throughput k8_progress_throttle k12_late_rows q1_check_constraints p4_parity_check""".split()
NAMES = list(queries()) if os.environ.get("CHRONOWEAVE_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    msg, _, _, ok = compare(spark, con, sf, name, queries()[name], oracle_sql().get(name))
    assert ok, msg


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
