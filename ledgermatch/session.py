"""Session settings the library is designed for.

On a cluster the caller owns the session; these settings are what the plans
assume. Nothing here is required for right results.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution picks broadcast or shuffled joins from measured sizes,
#: merges small shuffle partitions and splits hot ones. ``forceOptimizeSkewedJoin``
#: lets it split a hot key even inside a chain of joins on the same key, where
#: the split costs one more shuffle.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Text lists are built in object buffers; a map task may hold this many keys
    # before it falls back to sorting. The default of 128 sorts almost always.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "10000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.scheduler.mode": "FAIR",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ledgermatch")
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
