"""Every combination of several values per key.

A chain of left joins on one key gives all combinations of a key's values, and one task makes all of a
hot key's. Here the combinations of a key are numbered: with n1, n2, ... different values the number r
stands for the digits r mod n1, (r div n1) mod n2, ... So the numbers of a key can be dealt out in batches,
and each number finds its values by an equality join on key and digit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Combinations that are dealt out together.
BATCH = 4096
#: Parts in which the values of a key are numbered.
STRETCHES = 64


def _numbered(rows: DataFrame, key: str, value: str) -> DataFrame:
    """__key, __place (from 0), the value and __copies of the different values of each key; numbered in two levels."""
    stretch = F.pmod(F.xxhash64(value), F.lit(STRETCHES)).alias("__stretch")
    counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"), value).agg(F.count("*").alias("__copies"))
    placed = counted.select("*", stretch)
    before = Window.partitionBy("__key").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("__key", "__stretch").agg(F.count("*").alias("__n"))
    sums = sums.select("__key", "__stretch", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__earlier"))
    here = F.row_number().over(Window.partitionBy("__key", "__stretch").orderBy(F.col(value).asc_nulls_first())) - 1
    return placed.withColumn("__here", here).join(sums, ["__key", "__stretch"]).select(
        "__key", (F.col("__earlier") + F.col("__here")).alias("__place"), value, "__copies"
    )


def combinations(keys: DataFrame, key: str, attributes: list[tuple[DataFrame, str]]) -> DataFrame:
    """``keys`` (different values of ``key``) left joined to each attribute (rows of ``key`` and a value column of its own name).

    A key without a value of an attribute has NULL there; repeated values multiply, as they do in a join; a NULL key meets nothing.
    """
    numbered = [(_numbered(rows, key, value), value) for rows, value in attributes]
    out = keys.select(key)
    for i, (rows, _) in enumerate(numbered):
        sizes = rows.groupBy(F.col("__key").alias(f"__key{i}")).agg(F.count("*").alias(f"__n{i}"))
        out = out.join(sizes, F.col(key) == F.col(f"__key{i}"), "left")
    radix = [F.coalesce(F.col(f"__n{i}"), F.lit(1).cast("long")) for i in range(len(numbered))]
    total = reduce(Column.__mul__, radix, F.lit(1).cast("long"))
    starts = out.select(key, *(r.alias(f"__n{i}") for i, r in enumerate(radix)), total.alias("__total"))
    starts = starts.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__total") - 1, F.lit(BATCH).cast("long"))))
    # A number given keeps adaptive execution from merging the batches, which are few and small until they are unfolded.
    dealt = starts.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "__from")
    rows = dealt.withColumn("__r", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + BATCH, F.col("__total")) - 1)))
    for i in range(len(numbered)):
        rows = rows.withColumn(f"__d{i}", F.col("__r") % F.col(f"__n{i}")).withColumn("__r", F.expr(f"__r div __n{i}"))
    copies = F.lit(1).cast("long")
    for i, (values, value) in enumerate(numbered):
        its = values.select(F.col("__key").alias(f"__key{i}"), F.col("__place").alias(f"__place{i}"), value, F.col("__copies").alias(f"__copies{i}"))
        rows = rows.join(its, (F.col(key) == F.col(f"__key{i}")) & (F.col(f"__d{i}") == F.col(f"__place{i}")), "left")
        copies = copies * F.coalesce(F.col(f"__copies{i}"), F.lit(1).cast("long"))
    written = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return written.select(key, *(value for _, value in attributes))
