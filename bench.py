"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voltframe.session import local_session  # noqa: E402
from voltframe.workload import QUERIES  # noqa: E402

HEADLINE = (
    "valid_events", "dead_letter", "on_time_events", "merge_latest", "backfill_merge", "topic_route", "snapshot_id",
    "scan_filtered", "as_events", "expand_intervals", "resample_ffill", "series_gaps", "calendar_features",
    "lag_features", "ema_features", "rolling_features", "horizon_features", "asof_join", "asof_impute",
    "training_frame", "future_frame", "conformal_fit", "stacked_blend", "slice_regime", "holdout_eval",
    "seasonal_quantile_forecast", "backtest_summary", "forecast_upsert", "latest_forecasts", "release_ledger",
    "breach_streaks", "weather_weighted", "xml_points", "asof_join_all", "baselines", "holdout_split", "dual_training_rows",
    "feature_drift_psi", "conformal_apply", "snapshot_tree", "linear_backtest", "fold_quantiles", "backtest_report", "live_forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("voltframe-bench")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
