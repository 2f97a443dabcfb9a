"""Time every query of the library outside ``llm``: one JSON line.

``BENCH_SF_DIR`` names the test tables, ``BENCH_CPUS`` the number of local cores, ``BENCH_DIR`` the
folder for landed tables (default: a new one below the system's temporary folder; the bench is one local process).
The input relations of the derived datasets are landed as Parquet first, as they
would be on a cluster; that time is ``landing``, part of the total. Each query is run once to
warm up and then timed twice; the mean counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame

from ledgermatch import workload
from ledgermatch.fixtures import RELATIONS, relations
from ledgermatch.plans import DATASETS, Catalog
from ledgermatch.session import local_session

RUNS = 2


def run(df: DataFrame) -> None:
    """Compute every row and column and throw them away."""
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    def once() -> float:
        start = time.perf_counter()
        run(make())
        return time.perf_counter() - start

    once()
    return statistics.mean(once() for _ in range(RUNS))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, memory="16g")
    tables = relations(spark, sf_dir)

    start = time.perf_counter()
    landing = os.environ.get("BENCH_DIR") or tempfile.mkdtemp(prefix="ledgermatch-bench-")
    landed = {}
    for name in RELATIONS:
        tables[name].repartition(cpus).write.mode("overwrite").parquet(f"{landing}/{name}")
        landed[name] = spark.read.parquet(f"{landing}/{name}")
    landing_seconds = time.perf_counter() - start

    only = set(sys.argv[1:])
    seconds: dict[str, float] = {"landing": landing_seconds}
    for name, query in workload.QUERIES.items():
        if not only or name in only:
            # Derived datasets read the landed relations, all others the plain tables.
            seconds[name] = timed((lambda: Catalog(landed)[name]) if name in DATASETS else (lambda: query(spark, sf_dir)))

    queries = {name: round(s, 3) for name, s in seconds.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": queries,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
