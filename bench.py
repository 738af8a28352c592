"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs in full into a no-op sink, after one untimed warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "storage_by_kind",
    "storage_top_chats",
    "attachment_page",
    "activity_days",
    "activity_totals",
    "streaks",
    "top_people",
    "top_groups",
    "calendar_grid",
    "chat_list",
    "message_upsert",
    "reaction_state",
    "transcript_runs",
    "context_around",
    "window_text",
    "keyword_vocabulary",
    "keyword_strict",
    "filter_orders",
    "knn_exact",
    "hybrid_search",
]


def main() -> None:
    from chatlake import catalog
    from chatlake.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    run("storage_totals")
    seconds = {name: run(name) for name in wanted}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
