"""Time the headline queries; print one JSON line.

Each query runs once to warm up and then three times into the ``noop`` sink; the
median counts. Store updates are timed against a store filled beforehand.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINES = (
    "market_kpis",
    "limit_flags_price",
    "moving_averages",
    "board_streak",
    "history_derivation",
    "densify_history",
    "enrich_day",
    "canonicalize",
    "clean_daily_snapshot",
    "source_priority",
    "limit_up_pool",
    "big_losers",
    "stock_with_notes",
    "latest_trade_date",
)


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def median_of(action) -> float:
    action()
    return statistics.median(timed(action) for _ in range(RUNS))


def store_updates(spark) -> dict[str, float]:
    """Upsert the newest day, and the newest tenth of the days, into a full store."""
    from tapeloom.driver import adapter, store_queries
    from tapeloom.sources.store import PANEL

    store = store_queries.new_store(spark, "bench")
    store.append(PANEL, adapter.panel(spark, SF_DIR))
    days = sorted(row.trade_date for row in store.days().collect())
    batches = {"upsert_one_day": days[-1], "upsert_tenth_of_days": days[-len(days) // 10]}
    return {
        name: median_of(lambda first=first: store.upsert(store.table(PANEL, first)))
        for name, first in batches.items()
    }


def main() -> None:
    from tapeloom.driver import QUERIES
    from tapeloom.session import build_session

    spark = build_session(
        app="bench",
        master=f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "7g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        print(f"timing {name}", file=sys.stderr, flush=True)
        times[name] = median_of(
            lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        )
    if not sys.argv[1:]:
        times.update(store_updates(spark))
    times = {name: round(seconds, 3) for name, seconds in times.items()}
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
