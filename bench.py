"""Wall time of the headline queries, as one JSON line.

One warm-up, then the median of BENCH_RUNS runs per query, each run to completion without
collecting rows. ``BENCH_QUERIES=all`` or a comma-separated list changes the selection.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cuentaclara.plans.queries import QUERIES  # noqa: E402
from cuentaclara.session import build_session  # noqa: E402

HEADLINE = (
    "tenant_overview bronze_expenses bronze_hitl_tasks dead_letters scd1_expenses scd1_hitl scd2_expenses "
    "hitl_rollup trace_per_expense expense_audit event_history expense_audit_with_history kpi_tenant_daily "
    "expense_chunks hitl_discrepancies expectation_report layer_freshness ocr_amount_gap never_reached_ocr "
    "hitl_resolution_percentiles top_vendors ocr_drift_profile breadcrumb channel_replay_buffer chat_history "
    "ocr_normalize ocr_extra ocr_merge amount_normalize date_normalize compare_fields hitl_resolve source_per_field "
    "backfill_hitl_decision search_list search_sum latest_embedding semantic_topk lexical_topk hybrid_rrf "
    "citations cited_expenses strip_ungrounded log_traces log_latency model_decisions model_cost layer_presence"
).split()


def selection() -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "")
    if wanted == "all":
        return list(QUERIES)
    return [q for q in wanted.split(",") if q] or HEADLINE


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in selection():
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
