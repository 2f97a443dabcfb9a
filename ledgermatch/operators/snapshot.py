"""Versions of data: snapshots named by a registry, consolidations by number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_snapshots(registry: DataFrame, supplier: str, data_type: str) -> DataFrame:
    """Snapshot ids that the registry marks as latest for a supplier's data."""
    return registry.where(
        (F.col("supplier_id") == supplier) & (F.col("data_type") == data_type) & (F.col("latest") == "Y")
    ).select("snapshot_id")


def in_latest(df: DataFrame, registry: DataFrame, supplier: str, data_type: str) -> DataFrame:
    """Rows of any latest snapshot (the registry may name several)."""
    return df.join(latest_snapshots(registry, supplier, data_type), "snapshot_id", "left_semi").select(
        *df.columns
    )


def at_latest(df: DataFrame, registry: DataFrame, supplier: str, data_type: str) -> DataFrame:
    """Rows of the one latest snapshot; more than one in the registry is an error."""
    return df.where(F.col("snapshot_id") == latest_snapshots(registry, supplier, data_type).scalar())


def greatest(df: DataFrame, version: str) -> Column:
    """The greatest version as a scalar subquery; Spark pushes it into the scan."""
    return df.agg(F.max(version)).scalar()


def stamp(df: DataFrame, consolidation_id: int) -> DataFrame:
    return df.withColumn("consolidation_id", F.lit(consolidation_id).cast("bigint"))


def write_consolidation(df: DataFrame, path: str, consolidation_id: int) -> None:
    """Materialise a derived dataset under one consolidation.

    Only the partition of this consolidation is replaced, so earlier ones stay
    and a failed run can be repeated.
    """
    (
        stamp(df, consolidation_id)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("consolidation_id")
        .parquet(path)
    )
