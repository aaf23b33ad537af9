"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from tablemill import registry
from tablemill.session import local_session

HEADLINE = [
    "Q01_chart", "Q02_affinity", "Q03_unstack", "Q04_measurement_view", "Q05_project_timeline_view", "Q06_training_matrix",
    "Q07_entity_feature_table", "Q08_source_merge", "A06_metric_rollup", "A13_quantile_profile", "A19_upper_median_row",
    "A25_correlation_matrix", "E06_binary_metrics", "E09_lift_gain", "J10_expanding_prior", "J12_second_degree",
    "M01_downsample", "R05_daily_interpolate", "R06_grid_interpolate", "S13_html_tables", "W07_lag_window_aggregate",
    "W11_trailing_sum_ewma", "W17_percent_rank_avg", "X13_text_normalise_terms", "G03_stationary_rank",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    registry.QUERIES["T01_top_n"](spark, folder).count()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    # the reference point is rows per second of the unstack job alone, its input already built
    from tablemill.operators.series import unstack_timeseries
    from tablemill.registry.series import metric_index
    from tablemill.session import settle

    index = settle(metric_index(spark, folder))
    rows = index.count()
    start = time.perf_counter()
    unstack_timeseries(index, pre_aggregated=[44]).write.format("noop").mode("overwrite").save()
    unstack = time.perf_counter() - start
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "unstack_input_rows": rows,
                "unstack_rows_per_second": round(rows / unstack),
            }
        )
    )


if __name__ == "__main__":
    main()
