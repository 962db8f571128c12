"""Time the headline queries and print one JSON line.

Every query runs in full into a sink that discards rows. Reported is the median of three runs
after one warm-up, pre-passes and vocabulary included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from blockloom.plans import catalog
from blockloom.session import local_session

HEADLINE = (
    "tokenize_native",
    "vocab_topk",
    "pack_blocks",
    "pack_dropped",
    "corpus_stats",
    "shuffle_epoch",
    "rank_shards",
    "collate_pad",
    "labels_mlm",
    "labels_clm",
    "progress",
    "val_loss",
    "system_metrics",
    "cache_trim",
    "run_plan",
)
RUNS = 3


def timed(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, app="bench")
    known = catalog.queries()
    seconds = {}
    for name in names:
        timed(spark, known[name], sf_dir)
        seconds[name] = round(statistics.median(timed(spark, known[name], sf_dir) for _ in range(RUNS)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
