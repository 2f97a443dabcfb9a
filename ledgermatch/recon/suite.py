"""Run a suite of checks over two sides."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgermatch.recon import report
from ledgermatch.recon.diff import compare_columns, differing_rows, prepare, sample_rows, written_groups
from ledgermatch.recon.spec import CheckSpec, CheckSuite
from ledgermatch.recon.verdict import BAG_MISMATCH, MISMATCH, RESULT_SCHEMA, error_verdict, verdict

SAMPLE_SCHEMA = "name string, side string, rank bigint, row_json string"


class DatasetSource(Protocol):
    """Where the two sides come from."""

    def missing(self, dataset: str) -> str | None:
        """A message when an input does not exist, else None."""

    def load(self, side: str, dataset: str) -> DataFrame:
        """The rows of one side ('src' or 'trg')."""


class SuiteResult:
    """Collected verdicts (one row per dataset) and bounded samples."""

    def __init__(self, spark: SparkSession, verdicts: list[Row], samples: list[Row]) -> None:
        self.results = spark.createDataFrame(verdicts, RESULT_SCHEMA)
        self.samples = spark.createDataFrame(samples, SAMPLE_SCHEMA)
        self.summary = report.summary(self.results)
        self.totals = report.totals(self.summary)
        self.details = report.details(self.results)


@contextmanager
def _groups(spark: SparkSession, src: DataFrame, trg: DataFrame, spec: CheckSpec, folder: str | None) -> Iterator[DataFrame | None]:
    """The groups of both sides as a table below ``folder`` while samples may be asked of them; None where one job needs no table."""
    s, t = prepare(src, spec), prepare(trg, spec)
    wanted = folder and spec.sample_rows > 0 and not spec.digest and compare_columns(s, t).passed
    # A side without rows ends the check, so the other one need not be written.
    if not wanted or s.isEmpty() or t.isEmpty():
        yield None
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/groups-{uuid.uuid4().hex}")
    try:
        yield written_groups(s, t, path.toString(), spec.bag)
    finally:
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def check_dataset(
    spark: SparkSession, source: DatasetSource, spec: CheckSpec, folder: str | None = None
) -> tuple[Row, list[Row]]:
    """One verdict row and, on a mismatch, at most ``2 * sample_rows`` sample rows.

    With a ``folder`` that driver and executors share, both come from one pass over the two sides: the groups are written
    there for the time of the check, with the data of the rows that differ only. Without one, samples are a second job where rows
    differ. Digests keep no data, so their samples always are.
    """
    message = source.missing(spec.name)
    if message is not None:
        return error_verdict(spark, spec.name, message).first(), []
    src, trg = source.load("src", spec.name), source.load("trg", spec.name)
    with _groups(spark, src, trg, spec, folder) as groups:
        row = verdict(src, trg, spec, groups).first()
        if spec.sample_rows < 1 or row["data"]["reason"] not in (MISMATCH, BAG_MISMATCH):
            return row, []
        sides = prepare(src, spec), prepare(trg, spec)
        if spec.digest:
            sides = differing_rows(*sides, spec.bag)
        sample = sample_rows(*sides, spec.sample_rows, spec.bag, groups)
        return row, sample.select(F.lit(spec.name).alias("name"), "side", "rank", "row_json").collect()


def run_suite(
    spark: SparkSession, source: DatasetSource, suite: CheckSuite, parallelism: int = 4, folder: str | None = None
) -> SuiteResult:
    """Check every dataset of the suite; results keep the order of the list.

    Datasets are independent jobs. A few run at once so that the tail of one
    large diff does not leave the cluster idle. ``folder`` (``spark.checkpoint.dir`` if the session
    names one) is where the groups of datasets with samples are written, see ``check_dataset``.
    """
    folder = folder or spark.conf.get("spark.checkpoint.dir", None)

    def run(dataset: str) -> tuple[Row, list[Row]]:
        spark.sparkContext.setJobGroup(f"check-{dataset}", f"reconcile {dataset}")
        try:
            return check_dataset(spark, source, suite.spec(dataset), folder)
        except Exception as error:  # one broken dataset is a result; the others go on
            text = next((line.strip() for line in str(error).splitlines() if line.strip()), "")
            return error_verdict(spark, dataset, text or type(error).__name__).first(), []

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        outcomes = list(pool.map(run, suite.datasets))
    return SuiteResult(
        spark,
        [row for row, _ in outcomes],
        [sample for _, samples in outcomes for sample in samples],
    )
