"""

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]``: one cold run, then warm runs; reports the median warm
time per query and their sum as the metric. Every run executes the whole
plan with the ``noop`` sink (nothing is collected to the driver). Prints one
JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webloom.plans.catalog import QUERIES  # noqa: E402
from webloom.session import build_session  # noqa: E402

# headline query -> (registered query, warm runs)
HEADLINE = {
    "top100_words": ("top_k_words", 3),
    "html_to_blocks": ("text_blocks", 3),
    "article_extraction": ("extract_article", 3),
    "page_top_words": ("page_top_words", 3),
    "clean_text": ("clean_text", 3),
    "vocab_and_vectors": ("doc_vectors", 3),
    "topic_model_k10_20it": ("lda_fit", 1),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")}
    if not os.environ.get("SPARK_CHECKPOINT_DIR_SET"):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="bench-ckpt-")
    spark = build_session(f"local[{cpus}]", max(cpus, 8), app_name="webloom-bench", extra=extra)
    only = set(sys.argv[1:])
    times, cold = {}, {}
    for key, (name, warm) in HEADLINE.items():
        if only and key not in only:
            continue
        runs = []
        for i in range(1 + warm):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        cold[key] = round(runs[0], 3)
        times[key] = round(statistics.median(runs[1:]), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total_warm_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "cold": cold, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
