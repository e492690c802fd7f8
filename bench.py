"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma
separated names, or ``all``) choose the run. Every query writes its whole result to the
``noop`` sink; the first query runs once unmeasured to warm the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "asum axpy dot nrm2 iamax grouped_dot gemv gemv_transposed gemm gemm_sparse ger symv syrk syrk_gram coalesce_coo "
    "align case_errors function_verdict scenario_verdict expand_matrix apply_overrides generate_dataset validate_params "
    "line_table strip_comments segment_units unit_header declarations call_edges chunk topo_levels render_adjacency "
    "error_blocks failing_modules retry_set attempt_ledger strategy_overview function_summary fold_conversation "
    "latest_status running_counts"
).split()


def main() -> None:
    from sparkrecon import build_session
    from sparkrecon.queries import all_queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    known = all_queries()
    names = list(known) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])
    times = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
