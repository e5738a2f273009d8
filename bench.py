"""Times the headline queries from the raw tables and prints one JSON line.

Every timing starts without any staged intermediate, so it covers the whole
way from the parquet files to the result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests.session import make_session  # noqa: E402
from tidewater.plans import catalog  # noqa: E402
from tidewater.sources import staging  # noqa: E402

HEADLINE = [
    "pan01_forward_panel", "pan05_total_return", "pan11_stock_panel", "mom06_market_index", "mom07_group_baskets", "flw01_group_fund_flows", "flw03_trend_series",
    "sta02_daily_ic", "sta03_bucket_table", "sta06_block_bootstrap", "cal02_ambush_episodes", "cal07_signal_scan", "cel06_momentum_cells", "reg03_regime_history",
    "reg06_traffic_light", "val03_valuation_table", "val18_calendar_medians", "out01_forward_returns", "out06_stop_delay", "rec01_ratio_agreement",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = make_session()
    catalog.QUERIES["mom06_market_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        staging.forget()
        t0 = time.time()
        catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(n, times[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
