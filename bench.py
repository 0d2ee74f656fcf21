"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  Every
query runs to the end by writing its full result to the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from tomewright.queries import registry
from tomewright.session import build_session

HEADLINE = ["line_offsets", "chapters_from_headings", "chapter_bodies", "comparison_text", "segments_count",
            "segments_budget", "batches_grid", "coverage_summary", "missing_runs", "passages_exact",
            "passages_located", "slice_status", "digest_blocks", "reordered_digest", "chapter_anchors",
            "resolved_refs", "first_mentions", "page_metadata", "shelf_groups", "asof_state", "asof_states",
            "duplicate_chapters", "latest_progress", "order_audit", "mentions", "lint_digest", "quality_gate", "plan_continuity",
            "nav_chapters", "refreshed_text"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    fns = registry()
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()       # start the executors
    fns["comparison_text"][0](spark, sf_dir).limit(1).collect()     # and the Python workers
    times = {}
    for name in HEADLINE:
        t = time.time()
        fns[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
