"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from watchtide.plans import catalog
from watchtide.session import build_session

HEADLINE = (
    "normalize_findings", "triage_parse", "route_events", "query_findings", "extract_features", "ttl_dedup",
    "last_write_wins", "resource_config_lookup", "metric_rollup", "alarm_states", "train_val_split",
    "iforest_score", "score_findings", "chunk_fixed", "vector_topk", "keyword_search", "redact_text",
    "write_enriched", "stream_normalize", "stream_alerts", "read_scored", "kb_ingest", "hybrid_search",
)
RUNS = int(os.environ.get("BENCH_RUNS", "1"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.QUERIES
    queries["source_label"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM paths
    times = {}
    for name in HEADLINE:
        runs = []
        for _run in range(RUNS + 1):  # the first run warms up
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "total time of the headline queries, warm",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
