"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs three times (long ones once), until its last row is computed; the best run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dataprobe.plans import QUERIES  # noqa: E402
from dataprobe.session import JobConfig, build_session  # noqa: E402

HEADLINE = [
    "ind_pairs", "ucc_minimal", "ucc_lineitem", "ucc_lineitem_full", "lcs_best", "lcs_best_conversations", "lcs_best_documents",
    "gen_permutations", "resolve_tokens", "resolve_against", "audit_outcomes", "prime_range", "filter_prime", "lww_merge", "lamport_fold",
    "lamport_fold_long", "set_xor", "set_next", "bitmap_count_distinct", "top_per_group", "topk_salary", "join_theta_self",
    "bloom_semi_join",
]
#: Queries that take longer run once.
LONG_SECONDS = 30


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        JobConfig(cores=cpus, partitions=cpus, master=f"local[{cpus}]", app_name="bench"),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
            if runs[0] > LONG_SECONDS:
                break
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline queries, best of three, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
