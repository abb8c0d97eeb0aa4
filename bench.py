"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the repeats
(median is kept). Results go to the no-op sink, so whole result tables are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsevidence import checks  # noqa: E402
from newsevidence.session import build_session  # noqa: E402

HEADLINE = [
    "evidence_search", "evidence_search_cells", "clean_text", "sentences", "dedup_key", "semantic_chunks", "chunk_vectors",
    "chunk_rows", "embed_unique", "extract_pages", "robots", "domains", "discover", "api_articles", "rss_items", "hits_parse",
    "endpoint_attempt", "endpoint_state", "run_rollup", "keep_first", "latest_source", "article_ratings", "evidence_groups",
    "prompts", "verdicts", "audit", "apply_patches", "sync_ratings", "eligible", "claim_history",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    table = checks.queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            table[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
