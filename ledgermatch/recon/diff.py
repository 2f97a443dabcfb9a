"""Full-content comparison of two DataFrames in one shuffle.

Both sides are stacked with a side counter and grouped by every column. Each
group is a distinct row with its number of copies per side, which gives the row
counts, both EXCEPT results and, on request, the EXCEPT ALL results. Copies are
summed before the shuffle, so a row that fills a third of a table travels once
per map task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.functions.canonical import comparison_key, sort_text
from ledgermatch.recon.spec import CheckSpec

SRC_COPIES = "__src_copies"
TRG_COPIES = "__trg_copies"
DIGEST = "__digest"
SIDE = "__side"
COPIES_PER_BATCH = 10_000


def column(name: str) -> Column:
    """Reference a top-level column whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def require_unique_columns(df: DataFrame, what: str) -> DataFrame:
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"{what} has repeated column names: {repeated}")
    if df.sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        lowered = [c.lower() for c in df.columns]
        alike = sorted(c for c in df.columns if lowered.count(c.lower()) > 1)
        if alike:
            raise ValueError(f"{what} has columns that differ in case only: {alike}; set spark.sql.caseSensitive for these")
    return df


def apply_mapping(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename mapped columns; the same map serves both sides."""
    if not mapping:
        return df
    # Sources and targets both lead to the target, so either side may carry either name.
    renames = {name: target for source, target in mapping.items() for name in (source, target)}
    names = [renames.get(c, c) for c in df.columns]
    return require_unique_columns(df.toDF(*names), "mapping result")


def exclude_columns(df: DataFrame, exclude: tuple[str, ...]) -> DataFrame:
    keep = [c for c in df.columns if c not in set(exclude)]
    return df if len(keep) == len(df.columns) else df.select(*[column(c) for c in keep])


def prepare(df: DataFrame, spec: CheckSpec) -> DataFrame:
    require_unique_columns(df, f"dataset '{spec.name}'")
    return exclude_columns(apply_mapping(df, spec.mapping), spec.exclude)


@dataclass(frozen=True)
class ColumnComparison:
    passed: bool
    src_columns: list[str]
    trg_columns: list[str]
    missing_in_trg: list[str]
    missing_in_src: list[str]
    same_order: bool


def compare_columns(src: DataFrame, trg: DataFrame) -> ColumnComparison:
    """Compare column names; order is reported but does not decide."""
    owners: dict[str, set[str]] = {}
    for side, df in (("src", src), ("trg", trg)):
        for name in df.columns:
            owners.setdefault(name, set()).add(side)
    lone = {side: sorted(n for n, found in owners.items() if found == {side}) for side in ("src", "trg")}
    return ColumnComparison(
        not any(lone.values()), src.columns, trg.columns, lone["src"], lone["trg"], list(src.columns) == list(trg.columns)
    )


def comparable(src: DataFrame, trg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides in source column order, with values that can be grouped together."""
    src_types = {f.name: f.dataType for f in src.schema}
    trg_types = {f.name: f.dataType for f in trg.schema}

    def side(df: DataFrame, own: dict, other: dict) -> DataFrame:
        return df.select(*[comparison_key(column(c), own[c], other[c]).alias(c) for c in src.columns])

    return side(src, src_types, trg_types), side(trg, trg_types, src_types)


def _copies(src: DataFrame, trg: DataFrame) -> DataFrame:
    """Distinct rows of two comparable sides with their copies per side."""

    def side(df: DataFrame, is_src: int) -> DataFrame:
        return df.select(
            "*",
            F.lit(is_src).cast("bigint").alias(SRC_COPIES),
            F.lit(1 - is_src).cast("bigint").alias(TRG_COPIES),
        )

    stacked = side(src, 1).union(side(trg, 0))
    return stacked.groupBy(*[column(c) for c in src.columns]).agg(
        F.sum(SRC_COPIES).alias(SRC_COPIES), F.sum(TRG_COPIES).alias(TRG_COPIES)
    )


def row_groups(src: DataFrame, trg: DataFrame) -> DataFrame:
    """Distinct rows of both sides, in source column order, with copies per side."""
    return _copies(*comparable(src, trg))


def written_groups(src: DataFrame, trg: DataFrame, path: str, bag: bool = False) -> DataFrame:
    """``row_groups`` written to ``path`` and read back, so that counts and samples come from one pass over both sides.

    Only rows that are differences (see ``except_rows``) keep their data. All others are NULLs and two counts, a few bits each
    in a column store, so the table grows with what differs.
    """
    groups = row_groups(src, trg)
    src_only, trg_only = side_excess(bag)
    differs = (src_only > 0) | (trg_only > 0)
    types = {f.name: f.dataType for f in groups.schema}

    def storable(name: str) -> Column:
        return column(name).cast("string") if isinstance(types[name], T.NullType) else column(name)

    # Names of the data may be anything; in the table they are numbers.
    data = [F.when(differs, storable(c)).alias(f"c{i}") for i, c in enumerate(src.columns)]
    table = groups.select(*data, SRC_COPIES, TRG_COPIES)
    table.write.mode("overwrite").parquet(path)
    return src.sparkSession.read.schema(table.schema).parquet(path).toDF(*src.columns, SRC_COPIES, TRG_COPIES)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a comparable row.

    The digested text names each column that is not NULL, so it is different for
    different rows. Times are digested as text, because their JSON form ends at
    milliseconds. Adding zero makes -0.0 the 0.0 it equals. Columns under a
    collation can't be digested, see ``can_digest``.
    """

    def exact(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return column(f.name) + F.lit(0.0).cast(f.dataType)
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return column(f.name).cast("string")
        return column(f.name)

    values = [exact(f).alias(f"c{i}") for i, f in enumerate(df.schema)]
    return F.unhex(F.sha2(F.to_json(F.struct(*values)), 256)) if values else F.lit(b"")


def _collated(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StringType):
        return dtype.collation != "UTF8_BINARY"
    if isinstance(dtype, T.StructType):
        return any(_collated(f.dataType) for f in dtype)
    if isinstance(dtype, T.MapType):
        return _collated(dtype.keyType) or _collated(dtype.valueType)
    return isinstance(dtype, T.ArrayType) and _collated(dtype.elementType)


def can_digest(src: DataFrame, trg: DataFrame) -> bool:
    """Whether equal rows have equal digests: texts that a collation makes equal have different bytes."""
    return not any(_collated(side.schema) for side in comparable(src, trg))


def digest_groups(src: DataFrame, trg: DataFrame) -> DataFrame:
    """As ``row_groups``, with a digest in place of the row; the rows themselves where no digest serves."""
    if not can_digest(src, trg):
        return row_groups(src, trg)
    s, t = comparable(src, trg)
    return _copies(s.select(row_digest(s).alias(DIGEST)), t.select(row_digest(t).alias(DIGEST)))


def differing_rows(src: DataFrame, trg: DataFrame, bag: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides reduced to the rows whose digests do not agree; as they are where no digest serves."""
    if not can_digest(src, trg):
        return src, trg
    src_only, trg_only = side_excess(bag)
    wanted = digest_groups(src, trg).where((src_only > 0) | (trg_only > 0)).select(DIGEST)

    def reduced(df: DataFrame) -> DataFrame:
        return df.withColumn(DIGEST, row_digest(df)).join(wanted, DIGEST, "left_semi").drop(DIGEST)

    s, t = comparable(src, trg)
    return reduced(s), reduced(t)


def side_excess(bag: bool) -> tuple[Column, Column]:
    """How many copies of a group are only in src / only in trg."""
    s, t = F.col(SRC_COPIES), F.col(TRG_COPIES)
    if bag:
        return F.greatest(s - t, F.lit(0)), F.greatest(t - s, F.lit(0))
    return (
        F.when((s > 0) & (t == 0), 1).otherwise(0).cast("bigint"),
        F.when((t > 0) & (s == 0), 1).otherwise(0).cast("bigint"),
    )


def _differences(src: DataFrame, trg: DataFrame, bag: bool, most: int | None = None, groups: DataFrame | None = None) -> DataFrame:
    """SIDE ('src' / 'trg') and the data of rows on one side only; ``most`` bounds the copies of a row."""
    src_only, trg_only = side_excess(bag)
    surplus = src_only + trg_only if most is None else F.least(src_only + trg_only, F.lit(most))
    diff = (
        (row_groups(src, trg) if groups is None else groups)
        .withColumn(SIDE, F.when(src_only > 0, "src").when(trg_only > 0, "trg"))
        .withColumn("__surplus", surplus)
        .where(F.col(SIDE).isNotNull())
    )
    names = [column(c) for c in src.columns]
    if bag:
        # Copies in two steps, so that no array holds them all, and with the batches of a row
        # dealt out in between, so that no task writes all copies of one row.
        left, batch = F.col("__surplus"), F.col("__batch")
        one = F.lit(1).cast("bigint")
        diff = diff.withColumn("__batch", F.explode(F.sequence(one, F.ceil(left / COPIES_PER_BATCH))))
        if most is None:
            # A number given keeps adaptive execution from merging these few small rows again.
            tasks = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            diff = diff.repartition(tasks, *names, "__batch")
        diff = diff.withColumn(
            "__copy", F.explode(F.sequence(one, F.least(F.lit(COPIES_PER_BATCH), left - (batch - 1) * COPIES_PER_BATCH)))
        )
    return diff.select(SIDE, *names)


def except_rows(src: DataFrame, trg: DataFrame, bag: bool = False) -> DataFrame:
    """Rows found on one side only: a ``side`` column ('src' / 'trg') and the data.

    The frame keeps the full diff distributed. With ``bag`` a row comes once per
    surplus copy. If the data has a ``side`` column of its own, the first column is
    called ``__side``.
    """
    diff = _differences(src, trg, bag)
    clash = any(c.lower() == "side" for c in src.columns)
    return diff if clash else diff.withColumnRenamed(SIDE, "side")


def subtract(src: DataFrame, trg: DataFrame) -> DataFrame:
    """src EXCEPT trg, distinct and null-safe."""
    return _differences(src, trg, bag=False).where(F.col(SIDE) == "src").drop(SIDE)


def text_keys(df: DataFrame, columns: list[str]) -> list[Column]:
    """Every column as sortable text; numbers sort as text and NULL as its mark."""
    types = {f.name: f.dataType for f in df.schema}
    return [sort_text(column(c), types[c]) for c in columns]


def sample_rows(src: DataFrame, trg: DataFrame, k: int, bag: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """The first ``k`` differing rows per side in text order, as JSON text.

    Columns: side, rank (from 1), row_json. Each side is a top-k over the same
    grouped shuffle, so a task keeps at most ``k`` rows and the exchange is
    computed once and read twice. ``groups`` are the groups of both sides if they have been written already.
    """
    diff = _differences(src, trg, bag, most=k, groups=groups)
    keys = text_keys(diff, src.columns)
    as_json = F.to_json(
        F.struct(*[key.alias(c) for key, c in zip(keys, src.columns)]), {"ignoreNullFields": "false"}
    )

    def top(side: str) -> DataFrame:
        first = diff.where(F.col(SIDE) == side).orderBy(*keys).limit(k)
        return first.select(F.col(SIDE).alias("side"), F.array(*keys).alias("__order"), as_json.alias("row_json"))

    # At most 2k rows are left here.
    numbering = Window.partitionBy("side").orderBy("__order")
    return (
        top("src")
        .unionByName(top("trg"))
        .select("side", F.row_number().over(numbering).cast("bigint").alias("rank"), "row_json")
    )
