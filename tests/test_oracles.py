"""Registered queries against DuckDB. A sample by default; ``ALL_ORACLES=1`` runs every one."""

import os

import pytest

from tests.check_oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["flagship_weighted_top20", "t02_macd", "t04_kdj", "t22_kama", "v12_mainforce_resonance", "k08_cost_peak", "f33_financial_composite",
          "f53_filter_statistics", "j07_asof_forward_entry_exit", "j08_range_join", "a04_a05_quantiles", "w08_w09_ema_both", "l05_top_share_with_ties",
          "c02_strongest", "g05_extended_levels", "e03_daily_ic", "r02_tracking", "d12_table_diff", "x03_duplicate_news", "m02_enhanced_score",
          "st03_recent_ticks", "st07_board_events"]


def names():
    from tidemark.plans import load
    _, oracles = load()
    return sorted(oracles) if os.environ.get("ALL_ORACLES") else SAMPLE


@pytest.mark.parametrize("name", names())
def test_query_matches_oracle(spark, name):
    from tidemark.plans import load
    queries, oracles = load()
    ok, msg = compare(spark, connect(SF), SF, queries[name], oracles[name])
    assert ok, msg


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 250


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
