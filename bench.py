"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated),
BENCH_RUNS (default 1). After two queries as a warm-up of the JVM, each query runs whole, into a sink
that discards the rows, BENCH_RUNS times; its time, from building the plan to the last row, is the
shortest of them.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from registry.queries import QUERIES_BY_NAME  # noqa: E402
from termscale.session import build_session  # noqa: E402

# All queries of the library itself; those of an optional subpackage have a check of their own.
HEADLINE = list(QUERIES_BY_NAME)


def run(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES_BY_NAME[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        cpus,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    for name in ("topk_docs", "topk_words"):
        run(spark, name, sf_dir)
    timings = {name: min(run(spark, name, sf_dir) for _ in range(runs)) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
