"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from drawdown.plans.catalog import QUERIES  # noqa: E402
from drawdown.session import local_session  # noqa: E402

HEADLINE = ["monthly_rollup", "quality_gate", "unit_decline_rollup", "hierarchy_rollup", "peak_detection", "early_features", "new_entity_rule", "neighbour_features",
            "group_percentiles", "fit_best", "entity_decline_fit", "unit_components", "reconciliation", "standardized_measure", "indicator_scores", "bm25_top",
            "volumetric_monte_carlo", "import_issues"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))  # a fresh folder, so nothing stored by an earlier query is read
        t = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
