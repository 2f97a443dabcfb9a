"""Roll-ups: ordered text lists and counts per key.

A roll-up replaces a correlated aggregate per outer row. Several of them over
the same key are computed in one pass: their labels are stacked with a ``kind``
tag, made distinct, and aggregated once with one filtered aggregate per kind.

The distinct step shuffles by key *and* label, so a key that holds a third of
all rows is spread over many tasks and its repeats are dropped on the map side.
Only distinct labels reach the second shuffle, already combined per map task;
what one task finally holds for a key is the text cell it has to produce.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgermatch.functions.text import string_agg


@dataclass(frozen=True)
class Rollup:
    """One list column and its count column."""

    kind: str
    text: str
    count: str
    sep: str = ", "


def labels(
    df: DataFrame,
    kind: str,
    keys: list[str],
    label: str,
    identity: str | None = None,
) -> DataFrame:
    """Bring a relation into the stacked form: keys, kind, label, identity (if there is one), position (of numbers).

    Labels are distinct per (identity, label): two ids with equal labels stay
    two entries. A numeric label is listed in numeric order: by its nearest DOUBLE, then
    whole numbers and decimals that share it by their whole part and by the rest. Texts have no columns for that: every
    entry would carry them through two shuffles.
    """
    dtype = df.schema[label].dataType
    out = [*map(F.col, keys), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label")]
    if identity:
        out.append(F.col(identity).cast("string").alias("identity"))
    if isinstance(dtype, T.NumericType):
        exact = isinstance(dtype, (T.LongType, T.DecimalType))
        whole = F.floor(F.col(label)) if exact else F.lit(None)
        rest = F.col(label) - F.floor(F.col(label)) if isinstance(dtype, T.DecimalType) else F.lit(None)
        out += [F.col(label).cast("double").alias("position"), whole.cast("decimal(38,0)").alias("place"), rest.cast("decimal(38,37)").alias("rest")]
    return df.select(*out)


def roll_up_distinct(stacked: DataFrame, keys: list[str], rollups: list[Rollup]) -> DataFrame:
    """Aggregate already distinct labels; one row per key."""
    aggregates: list[Column] = []
    order = [c for c in ("position", "place", "rest", "label") if c in stacked.columns]
    for r in rollups:
        aggregates.append(
            string_agg("label", r.sep, order_by=order, where=f"kind = '{r.kind}'").alias(r.text)
        )
        # Counts every distinct entry, also one whose label is NULL.
        aggregates.append(F.count_if(F.col("kind") == r.kind).alias(r.count))
    return stacked.groupBy(*keys).agg(*aggregates)


def roll_up(stacks: list[DataFrame], keys: list[str], rollups: list[Rollup], apart: list[DataFrame] | None = None) -> DataFrame:
    """Distinct, then aggregate, all kinds in one pass.

    Stacks of ``apart`` have kinds of their own and a distinct step of their own: one that is distinct already, or dealt by its
    labels, needs no shuffle for it.
    """

    def together(frames: list[DataFrame]) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    stacked = together([together(stacks).distinct(), *(s.distinct() for s in apart or [])])
    return roll_up_distinct(stacked, keys, rollups)


def list_distinct(df: DataFrame, keys: list[str], label: str, rollup: Rollup) -> DataFrame:
    """List and count of a key's different labels, as ``roll_up`` has them, in one aggregate.

    A set per key is combined before the shuffle, if there is one: rows that are dealt by their key already needn't travel again.
    """
    if df.schema[label].dataType != T.StringType():
        return roll_up([labels(df, rollup.kind, keys, label)], keys, [rollup])
    sets = df.groupBy(*keys).agg(F.collect_set(label).alias("__set"), F.count_if(F.col(label).isNull()).alias("__nulls"))
    listed = F.when(F.size("__set") > 0, F.array_join(F.array_sort("__set"), rollup.sep))
    count = F.size("__set") + (F.col("__nulls") > 0).cast("int")
    return sets.select(*keys, listed.alias(rollup.text), count.cast("bigint").alias(rollup.count))


def distinct_ids(df: DataFrame, keys: list[str], identity: str, kinds: list[str] | None = None, deal: list[str] | None = None) -> DataFrame:
    """Distinct ``keys`` and ``identity``; rows are dealt by ``deal``, some of the keys, if it is given.

    Whole numbers travel as sets: one row for each 64 numbers in a row, a bit for each of them. So what a task knows of a key
    is a row or two, and adding up sets is a plain aggregate. Numbers far from each other have a row each, as others have.
    With ``kinds``, column ``kind`` has these values only; it belongs to the result, and a row has the sets of all of them.
    """
    dtype = df.schema[identity].dataType
    if not isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        rows = df.select(*keys, *(["kind"] if kinds else []), identity).distinct()
        return rows.repartition(*deal) if deal else rows
    number = F.col(identity).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(F.lit(63)).cast("int"))
    held = F.coalesce(bit, F.lit(1).cast("long"))  # NULL is in a set of its own
    own = {None: held} if kinds is None else {k: F.when(F.col("kind") == k, held) for k in kinds}
    blocks = df.groupBy(*keys, F.shiftright(number, 6).alias("__block"))
    sets = blocks.agg(*(F.bit_or(x).alias(f"__set{i}") for i, x in enumerate(own.values())))
    if deal:
        sets = sets.repartition(*deal)
    by_kind = F.array(*(F.struct(F.lit(k).cast("string").alias("__kind"), F.col(f"__set{i}").alias("__set")) for i, k in enumerate(own)))
    each = sets.select(*keys, "__block", F.inline(by_kind)).where("__set is not null")
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("__set", i) == 1)
    numbers = F.transform(bits, lambda i: F.col("__block") * 64 + i)
    unknown = F.array(F.lit(None).cast("long"))
    unfolded = each.select(*keys, "__kind", F.explode(F.when(F.col("__block").isNull(), unknown).otherwise(numbers)).alias("__number"))
    return unfolded.select(*keys, *([F.col("__kind").alias("kind")] if kinds else []), F.col("__number").cast(dtype).alias(identity))


def written_out(value: Column, copies: Column, sep: str) -> Column:
    """``value`` repeated ``copies`` times with ``sep`` between; NULL stays NULL."""
    before_last = F.repeat(F.concat(value, F.lit(sep)), (copies - 1).cast("int"))
    return F.concat(before_last, value)


def list_all(df: DataFrame, keys: list[str], value: str, sep: str, alias: str) -> DataFrame:
    """Ordered list of a key's values that keeps repeats.

    Repeats are counted first, in hash aggregates that combine before the shuffle,
    and written out from their counts: a key with very many rows sends its distinct
    values only.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("__copies"))
    pieces = counted.withColumn("__piece", written_out(F.col(value), F.col("__copies"), sep))
    return pieces.groupBy(*keys).agg(string_agg("__piece", sep, order_by=[value]).alias(alias))


def list_limited(df: DataFrame, keys: list[str], value: str, sep: str, alias: str, max_len: int) -> DataFrame:
    """The first ``max_len`` characters of the ordered list of a key's values, repeats included.

    A value shows ``max_len`` characters at most, so it is cut first; values that are equal up to there
    stay in order, as the first of them fills the list. Each further value takes its separator and one character or more, so no more than
    ``max_len / (len(sep) + 1)`` of them (and NULL, and the empty text) can show. Spark cuts a key to
    that number in every map task before it shuffles by key (up to ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000
    by default; beyond it the cut comes after the shuffle). So the task of a hot key reads as many rows a map task at
    most, however many values there are. Repeats are counted before.
    """
    counted = df.groupBy(*keys, F.left(value, F.lit(max_len)).alias("__shown")).agg(F.count("*").alias("__copies"))
    width = F.greatest(F.length("__shown") + len(sep), F.lit(1))
    copies = F.least(F.col("__copies"), F.floor(F.lit(max_len) / width) + 2)
    piece = F.left(written_out(F.col("__shown"), copies, sep), F.lit(max_len))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("__shown"))
    first = counted.select(*keys, "__shown", piece.alias("__piece"), rank.alias("__rank")).where(
        F.col("__rank") <= max_len // (len(sep) + 1) + 3
    )
    return first.groupBy(*keys).agg(string_agg("__piece", sep, order_by=["__shown"], max_len=max_len).alias(alias))


def attach(base: DataFrame, rolled: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Left join roll-ups to their base rows; a key without entries counts 0."""
    return base.join(rolled, keys, "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts}
    )


def count_distinct_per(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """Distinct non-NULL values per key; spread by key and value before counting."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias(alias))


def last_row(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Per key the row with the greatest ``order``, NULL counting as lowest.

    A maximum over a struct combines on the map side, so a key leaves each map task as one row, where a window
    would sort every row of a key in one task. With text columns Spark sorts each map task's rows for it.
    Ties go to the greater remaining columns.
    """
    best = F.max(F.struct(F.col(order).alias("__order"), *columns)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])
