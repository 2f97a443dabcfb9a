"""Relations of a database through Spark's JDBC source."""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How the two database families write a relation name.
MYSQL_RELATION = "{name}"
SQLSERVER_RELATION = "[dbo].[{name}]"


def _literal(value: Any) -> str:
    """A value as a SQL literal that both database families and Spark read."""
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal, str, datetime.date)):
        raise TypeError(f"no literal for a bound of type {type(value).__name__}")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    text = value.isoformat(" ") if isinstance(value, datetime.datetime) else str(value)
    if "\\" in text:  # an escape sign for one database and for Spark, a plain character for the other
        raise ValueError("no literal for a bound with a backslash")
    return "'" + text.replace("'", "''") + "'"


def depth_bounds(df: DataFrame, column: str, partitions: int, accuracy: int = 10_000) -> list:
    """Lower bounds of ``partitions`` ranges of about as many rows each; a value that fills several comes that often.

    For a frame, such as an earlier landing of the dataset. The quantiles come from mergeable sketches of bounded size,
    one a map task; each is off by one ``accuracy``-th of the rows at most. The column holds numbers, dates or times.
    NULLs have no place; without any value there are no bounds.
    """
    shares = [i / partitions for i in range(partitions)]
    row = df.agg(F.percentile_approx(column, shares, accuracy).alias("bounds")).first()
    return list(row["bounds"] or [])


@dataclass(frozen=True)
class RangeSplit:
    """Split a scan into ``partitions`` equal ranges of a numeric or time column.

    The bounds only place the ranges; rows outside them and NULLs are read too.
    """

    column: str
    lower: str | int
    upper: str | int
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


@dataclass(frozen=True)
class PredicateSplit:
    """Split a scan by predicates, one partition each.

    For keys whose values are unevenly spread, for instance by remainder. The
    predicates must cover every row exactly once; ``by_remainder`` adds the NULLs.
    """

    predicates: tuple[str, ...]

    @classmethod
    def by_remainder(cls, column: str, partitions: int) -> PredicateSplit:
        tests = [f"ABS({column} % {partitions}) = {i}" for i in range(partitions)]
        tests[0] = f"({tests[0]} OR {column} IS NULL)"
        return cls(tuple(tests))

    @classmethod
    def by_bounds(cls, column: str, bounds: Sequence[Any], within: str | None = None) -> PredicateSplit:
        """Ranges between ``bounds``, the lower bounds of ranges of equal depth in order of the column.

        A bound that comes r times is a value that fills r - 1 ranges or more: it is read by itself, and split into r
        parts by the remainder of the whole-numbered column ``within`` if that is given. Rows below the first
        bound and NULLs are one more part, so every row is read once whatever the bounds are. Without bounds there is one part.
        """
        if not bounds:
            return cls(("1 = 1",))
        often = Counter(bounds)
        values = list(often)
        tests = [f"({column} < {_literal(values[0])} OR {column} IS NULL)"]
        for value, after in zip(values, [*values[1:], None], strict=True):
            upto = "" if after is None else f" AND {column} < {_literal(after)}"
            if often[value] == 1:
                tests.append(f"{column} >= {_literal(value)}{upto}")
                continue
            alone = f"{column} = {_literal(value)}"
            parts = cls.by_remainder(within, often[value]).predicates if within else ()
            tests += [f"{alone} AND {p}" for p in parts] or [alone]
            tests.append(f"{column} > {_literal(value)}{upto}")
        return cls(tuple(tests))


@dataclass(frozen=True)
class JdbcSource:
    """One side's database.

    ``relation`` is the pattern of a qualified name, ``splits`` says per dataset
    how to read it in parallel (a dataset without an entry is read by one task),
    ``probe_sql`` is a query any live server of this kind answers.
    """

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    relation: str = MYSQL_RELATION
    splits: dict[str, RangeSplit | PredicateSplit] = field(default_factory=dict)
    probe_sql: str = "SELECT 1 AS x"
    fetch_size: int = 10_000

    def _options(self) -> dict[str, str]:
        return {"url": self.url, "fetchsize": str(self.fetch_size), **self.properties}

    def read(self, spark: SparkSession, dataset: str) -> DataFrame:
        """All rows of a table or view."""
        table = self.relation.format(name=dataset)
        split = self.splits.get(dataset)
        if isinstance(split, PredicateSplit):
            return spark.read.jdbc(
                self.url,
                table,
                predicates=list(split.predicates),
                properties={"fetchsize": str(self.fetch_size), **self.properties},
            )
        reader = spark.read.format("jdbc").options(**self._options()).option("dbtable", table)
        if split is not None:
            reader = reader.options(**split.options())
        return reader.load()

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """The rows of a read query, which the database runs."""
        return spark.read.format("jdbc").options(**self._options()).option("query", sql).load()

    def probe(self, spark: SparkSession) -> None:
        """Raise unless the database answers."""
        self.query(spark, self.probe_sql).collect()

    def bounds(self, spark: SparkSession, dataset: str, column: str, partitions: int) -> RangeSplit:
        """A range split whose bounds the database looks up; only two values are fetched."""
        table = self.relation.format(name=dataset)
        row = self.query(spark, f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}").first()
        if row["lo"] is None:
            return RangeSplit(column, 0, 1, 1)
        return RangeSplit(column, row["lo"], row["hi"], partitions)

    def depth_sql(self, dataset: str, column: str, partitions: int) -> str:
        """The query by which the database itself finds the bounds of ranges of equal depth."""
        table = self.relation.format(name=dataset)
        tiles = f"SELECT {column} AS v, NTILE({partitions}) OVER (ORDER BY {column}) AS tile FROM {table} WHERE {column} IS NOT NULL"
        return f"SELECT tile, MIN(v) AS bound FROM ({tiles}) x GROUP BY tile"

    def depth_split(self, spark: SparkSession, dataset: str, column: str, partitions: int, within: str | None = None) -> PredicateSplit:
        """A split into ranges of equal depth, for columns that are unevenly spread; one bound a partition is fetched."""
        rows = self.query(spark, self.depth_sql(dataset, column, partitions)).collect()
        return PredicateSplit.by_bounds(column, [r["bound"] for r in sorted(rows, key=lambda r: r["tile"])], within)
