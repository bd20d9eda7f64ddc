"""Headline-query benchmark: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Each query runs to completion through the no-op sink (no driver collect);
times are wall seconds after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "survey_embedding_summary", "embed_subjects_max", "filter_funnel", "score_two_level",
    "sample_n", "kmeans_fixed", "intrinsic_sweep", "silhouette", "grid_predictions",
    "pairwise_scores", "pairwise_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ["BENCH_CPUS"] = cpus
    from itemspace.plans import catalog
    from itemspace.session import build_session
    catalog.load_all()
    spark = build_session(master=f"local[{cpus}]")
    extra = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    names = extra or HEADLINE
    # warm-up (JVM, codegen caches)
    catalog.QUERIES["responses_long"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
