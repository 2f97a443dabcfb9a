"""The verdict on one dataset as a one-row DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.recon.diff import (
    SRC_COPIES,
    TRG_COPIES,
    compare_columns,
    digest_groups,
    prepare,
    require_unique_columns,
    row_groups,
    side_excess,
)
from ledgermatch.recon.spec import CheckSpec

# Tags and reasons as they appear in reports.
PASS = "PASS"
FAIL = "FAIL"
ERROR = "-ER-"
NULL = "NULL"
EXACT_MATCH = "Exact match"
MISMATCH = "Data mismatch-EXCEPT semantics"
BAG_MISMATCH = "Data mismatch-EXCEPT ALL semantics"
BOTH_EMPTY = "Skipping due to both datasets empty"
ONE_EMPTY = "Skipping due to one dataset empty"
COLUMN_MISMATCH = "Skipped: column mismatch"
MISSING_FILE = "Skipped: missing file"

RESULT_SCHEMA = """
    name string, src_count bigint, trg_count bigint, row_count_passed boolean,
    columns struct<passed: boolean, src_columns: array<string>, trg_columns: array<string>,
                   missing_in_trg: array<string>, missing_in_src: array<string>, same_order: boolean>,
    data struct<passed: boolean, reason: string, src_only_count: bigint, trg_only_count: bigint>,
    error_message string
"""


def _texts(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items]).cast("array<string>")


def _total(of: Column | str) -> Column:
    return F.coalesce(F.sum(of), F.lit(0)).cast("bigint")


def _counts_only(src: DataFrame, trg: DataFrame) -> DataFrame:
    """Row counts of sides that cannot be stacked; reads no column."""
    ones = src.select(F.lit(1).alias("s"), F.lit(0).alias("t"))
    return ones.union(trg.select(F.lit(0), F.lit(1))).agg(
        _total("s").alias("n_src"),
        _total("t").alias("n_trg"),
        F.lit(None).cast("bigint").alias("src_only"),
        F.lit(None).cast("bigint").alias("trg_only"),
    )


def verdict(src: DataFrame, trg: DataFrame, spec: CheckSpec, groups: DataFrame | None = None) -> DataFrame:
    """Compare two sides; one lazy row in ``RESULT_SCHEMA``.

    Everything comes out of one grouped aggregate: the counts decide whether a
    side is empty, and expressions on that one row pick the outcome. Row counts
    are of the bags, so merging rows by an excluded column does not change them.
    ``groups`` are the groups of both prepared sides if they have been written already.
    """
    require_unique_columns(src, f"source of '{spec.name}'")
    require_unique_columns(trg, f"target of '{spec.name}'")
    s, t = prepare(src, spec), prepare(trg, spec)
    names = compare_columns(s, t)

    if names.passed:
        src_only, trg_only = side_excess(spec.bag)
        if groups is None:
            groups = digest_groups(s, t) if spec.digest else row_groups(s, t)
        totals = groups.agg(
            _total(SRC_COPIES).alias("n_src"),
            _total(TRG_COPIES).alias("n_trg"),
            _total(src_only).alias("src_only"),
            _total(trg_only).alias("trg_only"),
        )
    else:
        totals = _counts_only(src, trg)

    n_src, n_trg = F.col("n_src"), F.col("n_trg")
    both_empty = (n_src == 0) & (n_trg == 0)
    some_empty = (n_src == 0) | (n_trg == 0)
    equal = (F.col("src_only") == 0) & (F.col("trg_only") == 0)

    # An empty side ends the check before mapping, so it reports the raw names.
    columns = F.struct(
        F.when(some_empty, False).otherwise(names.passed).alias("passed"),
        F.when(some_empty, _texts(src.columns)).otherwise(_texts(names.src_columns)).alias("src_columns"),
        F.when(some_empty, _texts(trg.columns)).otherwise(_texts(names.trg_columns)).alias("trg_columns"),
        F.when(some_empty, _texts([])).otherwise(_texts(names.missing_in_trg)).alias("missing_in_trg"),
        F.when(some_empty, _texts([])).otherwise(_texts(names.missing_in_src)).alias("missing_in_src"),
        F.when(both_empty, True).when(some_empty, False).otherwise(names.same_order).alias("same_order"),
    )
    compared = ~some_empty & F.lit(names.passed)
    data = F.struct(
        (compared & F.coalesce(equal, F.lit(False))).alias("passed"),
        F.when(both_empty, BOTH_EMPTY)
        .when(some_empty, ONE_EMPTY)
        .when(~F.lit(names.passed), COLUMN_MISMATCH)
        .when(equal, EXACT_MATCH)
        .otherwise(BAG_MISMATCH if spec.bag else MISMATCH)
        .alias("reason"),
        F.when(compared, F.col("src_only")).alias("src_only_count"),
        F.when(compared, F.col("trg_only")).alias("trg_only_count"),
    )
    return totals.select(
        F.lit(spec.name).alias("name"),
        n_src.alias("src_count"),
        n_trg.alias("trg_count"),
        (n_src == n_trg).alias("row_count_passed"),
        columns.alias("columns"),
        data.alias("data"),
        F.lit(None).cast("string").alias("error_message"),
    )


def error_verdict(spark: SparkSession, name: str, message: str) -> DataFrame:
    """The verdict on a dataset whose input is missing."""
    nothing = _texts([])
    return spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit(0).cast("bigint").alias("src_count"),
        F.lit(0).cast("bigint").alias("trg_count"),
        F.lit(False).alias("row_count_passed"),
        F.struct(
            F.lit(False).alias("passed"),
            nothing.alias("src_columns"),
            nothing.alias("trg_columns"),
            nothing.alias("missing_in_trg"),
            nothing.alias("missing_in_src"),
            F.lit(False).alias("same_order"),
        ).alias("columns"),
        F.struct(
            F.lit(False).alias("passed"),
            F.lit(MISSING_FILE).alias("reason"),
            F.lit(None).cast("bigint").alias("src_only_count"),
            F.lit(None).cast("bigint").alias("trg_only_count"),
        ).alias("data"),
        F.lit(message).alias("error_message"),
    )
