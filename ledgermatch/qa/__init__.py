"""Quick looks over many datasets: do they answer, what columns have they."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.functions.text import string_agg


def _stacked(frames: list[DataFrame]) -> DataFrame:
    """Union in halves: Spark analyses the plan at each union, so keep the tree flat."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return _stacked(frames[:middle]).unionByName(_stacked(frames[middle:]))


def row_counts(datasets: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """view_name, row_count; counting reads no column that a dataset can do without."""
    counts = [
        datasets[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("view_name"), "row_count")
        for name in names
    ]
    return _stacked(counts).orderBy("view_name")


#: Spark removes the shuffle files of a query when it ends, not when the driver's garbage happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def row_counts_apart(spark: SparkSession, datasets: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """``row_counts``, counted here and one after the other: the disk holds the shuffle of one dataset at a time, not of all."""
    with shuffles_removed(spark):
        rows = [(name, datasets[name].count()) for name in names]
    return spark.createDataFrame(rows, "view_name string, row_count bigint").orderBy("view_name")


def column_lists(spark: SparkSession, datasets: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """view_name, columns_list in column order; from the schemas, without running anything."""
    rows = [(name, i, c) for name in names for i, c in enumerate(datasets[name].columns)]
    columns = spark.createDataFrame(rows, "view_name string, ordinal int, column_name string")
    return (
        columns.groupBy("view_name")
        .agg(string_agg("column_name", ", ", order_by=["ordinal"]).alias("columns_list"))
        .orderBy("view_name")
    )
