"""Extract datasets of both sides into the landing area."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ledgermatch.sources.landing import SIDES, Landing

PROBE_SCHEMA = "side string, ok boolean, error string"
LOG_SCHEMA = "side string, dataset string, rows bigint, error string"


def _first_line(error: Exception) -> str:
    """The message without the JVM's stack trace."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    if len(lines) > 1 and lines[0].startswith("An error occurred while calling"):
        lines = lines[1:]
    return lines[0].removeprefix(": ") if lines else type(error).__name__


class Source(Protocol):
    def probe(self, spark: SparkSession) -> None: ...

    def read(self, spark: SparkSession, dataset: str) -> DataFrame: ...


def check_sources(spark: SparkSession, sources: dict[str, Source]) -> DataFrame:
    """One row per side: does its source answer, and if not, why."""
    rows = []
    for side in SIDES:
        source = sources.get(side)
        try:
            if source is None:
                raise ValueError("no connection is configured for this side")
            source.probe(spark)
            rows.append((side, True, None))
        except Exception as error:  # an unreachable source is a result, not a crash
            rows.append((side, False, _first_line(error)))
    return spark.createDataFrame(rows, PROBE_SCHEMA)


def extract(
    spark: SparkSession, sources: dict[str, Source], datasets: list[str], data_dir: str, fmt: str = "parquet", parallelism: int = 4
) -> DataFrame:
    """Land every dataset of both sides; returns a log row per side and dataset.

    Nothing is read unless both sources answer. A dataset that fails is logged
    and the rest go on. Each dataset replaces what was landed for it before, in whatever
    form, so a run can be repeated. A few datasets are extracted at a time.
    """
    failed = [r for r in check_sources(spark, sources).collect() if not r["ok"]]
    if failed:
        raise ConnectionError("; ".join(f"[{r['side']}] {r['error']}" for r in failed))
    landing = Landing(spark, data_dir)

    def land(job: tuple[str, str]) -> tuple:
        side, dataset = job
        try:
            return side, dataset, landing.publish(side, dataset, sources[side].read(spark, dataset), fmt).rows, None
        except Exception as error:  # isolate a dataset's failure
            return side, dataset, None, _first_line(error)

    jobs = [(side, dataset) for side in SIDES for dataset in dict.fromkeys(datasets)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        log = list(pool.map(land, jobs))
    return spark.createDataFrame(log, LOG_SCHEMA)


class FrameSource:
    """Named DataFrames as a source, for instance the derived datasets of a catalog."""

    def __init__(self, frames) -> None:
        self._frames = frames

    def probe(self, spark: SparkSession) -> None:
        spark.range(1).collect()

    def read(self, spark: SparkSession, dataset: str) -> DataFrame:
        return self._frames[dataset]
