"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "coh_longlos",
    "coh_invasive_vent",
    "coh_sepsis",
    "fx_measurement",
    "fx_long_features",
    "fx_wide_features",
    "spl_stratified3",
    "smp_group_balanced",
    "pp_quantile_fit",
    "pp_all_steps",
    "ev_auc",
    "ev_stratified",
    "ev_ece_quantile",
    "ev_ace_logistic",
    "fr_ova_frame",
    "agg_quantiles",
    "bs_evaluate_ci",
    "bs_compare_avg",
    "rpt_results_table",
    "dg_coral",
]


def bootstrap(n_boot):
    """The resampling workload in blocks of replicates: interval per metric, phase and run."""

    def run(spark, sf_dir):
        from strataflow.operators.replicates import replicate_intervals
        from strataflow.sources.fixtures import Views

        metrics = ["auc", "auprc", "loss_bce"]
        return replicate_intervals(Views(spark, sf_dir).predictions(), n_boot, ["phase", "iter"], metrics=metrics)

    return run


def main() -> None:
    from strataflow.plans import all_queries
    from strataflow.session import local_session

    spark = local_session(CPUS, shuffle_partitions=int(CPUS), memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    work = {name: all_queries()[name] for name in HEADLINE}
    work["bs_100_replicates"] = bootstrap(100)
    work["bs_1000_replicates"] = bootstrap(1000)
    # one small query starts the JVM's compilers and the file readers
    work["coh_longlos"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, fn in work.items():
        t0 = time.perf_counter()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": SF_DIR.rstrip("/").split("sf")[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
