"""Registered queries against their SQL on the smallest tables.

A sample by default; FULL=1 runs every query (several minutes).
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect

ROOT = "/root/testdata/sf0.001"
SAMPLE = ("adjusted_prices universe_history win_trailing_return win_sector_z technical_panel trade_levels join_asof_pit pit_fundamentals score_total topk_diverse "
          "quintile_portfolios agg_rank_ic drift_nav walk_forward backtest_holdings agg_attribution nav_curve_points order_summary stream_daily_bars "
          "stream_nav_upsert stream_wilder_state sink_recommendation scan_fixed_width_bars fn_trading_day filter_stale_prices").split()
NAMES = list(queries()) if os.environ.get("FULL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = queries()[name](spark, ROOT)
    rows = [tuple(r) for r in df.collect()]
    sql = oracle_sql().get(name)
    if sql:
        cur = connect(ROOT).execute(sql)
        assert compare(rows, df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


def test_entry(spark):
    assert entry(spark).schema.names == ["leg", "t", "n", "gross", "net", "turnover"]
