"""Distinct pairs of values that meet through a third, such as feeds and the products of their sources.

A plain join writes a row per meeting and shuffles it for the distinct step, and once more for whatever asks
for one of the values. Here one side is gathered into short lists per meeting point, so a row that travels is a
value with a list of partners, and it travels once: to the task that holds the value. There lists are unfolded and
made distinct, and a join or an aggregate on the value finds its rows in place. A list of texts travels as one text; an array
takes 16 bytes and more for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Partners in one list, more or less; a meeting point with more has several lists.
LIST_LENGTH = 256
#: Stands between the texts of a list; a list that has it in a text, or a NULL, stays an array.
SEPARATOR = "\x1f"


def _folded(array: Column, whole: Column) -> list[Column]:
    """``__text`` or ``__partners`` of a list; ``whole``: it has no NULL. Lists of other values than plain texts have no ``__text``."""
    text = F.array_join(array, SEPARATOR)
    joints = F.length(text) - F.length(F.replace(text, F.lit(SEPARATOR), F.lit("")))
    as_text = whole & (joints == F.size(array) - 1)
    return [F.when(as_text, text).alias("__text"), F.when(~as_text, array).alias("__partners")]


def _is_text(rows: DataFrame, partner: str) -> bool:
    return rows.schema[partner].dataType == T.StringType()


def _lists(rows: DataFrame, partner: str, through: list[str]) -> DataFrame:
    """``through`` and the different partners of each meeting point, NULL being one of them, as ``_folded`` has them."""
    own = rows.select(partner, *through).where(reduce(Column.__and__, [F.col(c).isNotNull() for c in through]))
    # One shuffle: distinct rows, their number and the lists all stay with the meeting point.
    own = own.repartition(*through).distinct()
    sizes = own.groupBy(*through).agg(F.count("*").alias("__n"))
    part = F.pmod(F.xxhash64(partner), F.ceil(F.col("__n") / LIST_LENGTH)).alias("__part")
    parts = own.join(sizes.hint("shuffle_hash"), through).select(partner, *through, part)
    blank = F.array(F.lit(None).cast(rows.schema[partner].dataType))
    listed = F.concat(F.collect_list(partner), F.when(F.count_if(F.col(partner).isNull()) > 0, blank).otherwise(F.array()))
    listed = parts.groupBy(*through, "__part").agg(listed.alias("__list"), F.count_if(F.col(partner).isNull()).alias("__nulls"))
    folded = _folded(F.col("__list"), F.col("__nulls") == 0) if _is_text(rows, partner) else [F.col("__list").alias("__partners")]
    return listed.select(*through, *folded)


def _unfolded(lists: DataFrame, partner: str, value: str, keep: list[str]) -> DataFrame:
    there = lists.repartition(value, *keep)
    partners = F.coalesce(F.split("__text", SEPARATOR, -1), F.col("__partners")) if "__text" in lists.columns else F.col("__partners")
    return there.select(value, *keep, F.explode(partners).alias(partner)).distinct()


def _met(left: DataFrame, partner: str, right: DataFrame, value: str, through: list[str], keep: list[str]) -> DataFrame:
    # Lists are the short side of each task; the other one needn't be sorted.
    lists = _lists(left, partner, through)
    folded = [c for c in lists.columns if c not in through]
    return right.join(lists.hint("shuffle_hash"), through).select(value, *keep, *folded)


def linked(left: DataFrame, partner: str, right: DataFrame, value: str, through: list[str], keep: list[str]) -> DataFrame:
    """Distinct ``value``, ``keep`` and ``partner`` of rows of both sides that agree in ``through``; dealt by value and ``keep``.

    ``keep`` are some of ``through``. A NULL in ``through`` meets nothing; NULL partners and values are values of their own.
    """
    return _unfolded(_met(left, partner, right, value, through, keep), partner, value, keep)


def linked_and(more: DataFrame, left: DataFrame, partner: str, right: DataFrame, value: str, through: list[str], keep: list[str]) -> DataFrame:
    """``linked`` and the rows of ``more`` (``value``, ``keep`` and ``partner``), distinct as a whole."""
    one = F.array(partner)
    own = more.select(value, *keep, *(_folded(one, F.col(partner).isNotNull()) if _is_text(left, partner) else [one.alias("__partners")]))
    return _unfolded(_met(left, partner, right, value, through, keep).unionByName(own), partner, value, keep)
