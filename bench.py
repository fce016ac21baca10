"""Bench: time the headline queries at ``$BENCH_SF_DIR`` and print one JSON line.

Each query runs to a sink that evaluates every row and column and keeps nothing.  It is
built and run twice and the faster time counts, so that the first queries are not charged
with the warm-up of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from quillweave.plans.queries import QUERIES
from quillweave.session import local_session

HEADLINE = (
    "mask_summary", "mask_poisson", "mask_poisson_fields", "mask_structured", "mask_steps",
    "mask_one_turn", "mask_solution", "qa_article", "qa_news", "qa_pairs_from_turns",
    "infill_roundtrip", "shuffle_rank", "sample_wor", "sample_wr", "split_90_10",
    "mix_weights", "mix_long_short", "mix_quotas", "chat_render", "token_budget",
    "reward_several", "reward_stats", "page_n", "jsonl_roundtrip", "publish_layout",
    "build_all_pairs", "build_all_qa",
)


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{folder}/documents.parquet").count()  # start the executors
    spent = {}
    for name in names:
        times = []
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        spent[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))
