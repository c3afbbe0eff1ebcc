"""Wall time of the headline queries: one JSON line. Each is run once to warm up code, then timed.

BENCH_SF_DIR: the tables (default sf0.1); BENCH_CPUS: cores of the local session (default 8).
"""

from __future__ import annotations

import json
import os
import time

from tracewright.queries import QUERIES
from tracewright.session import local_session

HEADLINES = (
    "flagship", "reentrancy", "call_ancestor_kind", "storage_call_kind", "log_decoded_false", "candidates_classic_reentrancy",
    "grounding_classic_reentrancy", "sequence", "same_call", "global_negated", "net_value_extracted", "precision_recall_f1",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus, **{"spark.sql.shuffle.partitions": str(2 * cpus)})
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
