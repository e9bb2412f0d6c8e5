"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Each query runs once untimed, so that the times are those of a warm JVM.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lexisieve.plans.queries import REGISTRY  # noqa: E402
from lexisieve.session import build_session  # noqa: E402

HEADLINE = [
    "curate", "rule_filter", "validity", "tokenize", "fingerprint", "dedup_key", "known_exact", "known_near",
    "similarity_high", "containment_filter", "fragment_score", "screen_cascade", "describe_columns", "histogram",
    "conditional_entropy", "global_index", "ranking_auc", "rolling_mean", "mix_sources", "stratified_folds",
    "knn_join", "property_lookup",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):  # one machine
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-"))
    names = [n for n in sys.argv[1:] if n in REGISTRY] or HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        times = {}
        for name in names:
            for timed in (False, True):
                start = time.time()
                REGISTRY[name](spark, sf).write.format("noop").mode("overwrite").save()
                if timed:
                    times[name] = round(time.time() - start, 3)
            print(name, times[name], flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
