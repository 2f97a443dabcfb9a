"""Joins whose NULL or multiplicity rules need care.

A side is broadcast only when its measured size is below the session's threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [left[a] == right[b] for a, b in keys])


def left_with(
    left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], right_only: Column | None = None
) -> DataFrame:
    """Left outer join whose condition also restricts the right side.

    The restriction belongs to the join condition, so it must not remove left
    rows: it is applied to the right side before joining. Right columns must not
    repeat left names.
    """
    if right_only is not None:
        right = right.where(right_only)
    return left.join(right, _same(left, right, keys), "left")


def left_with_existing(
    left: DataFrame,
    right: DataFrame,
    keys: list[tuple[str, str]],
    allowed: DataFrame,
    allowed_keys: list[tuple[str, str]],
) -> DataFrame:
    """Left outer join to the right rows for which an ``allowed`` row exists."""
    right = right.join(allowed, _same(right, allowed, allowed_keys), "left_semi")
    return left.join(right, _same(left, right, keys), "left")


def exists(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    return left.join(right, _same(left, right, keys), "left_semi")


def not_exists(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows without a match; a NULL key never matches, so its row stays."""
    return left.join(right, _same(left, right, keys), "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """``key NOT IN (SELECT right_key ...)`` with SQL's NULL rules, at any size.

    A NULL in the list rejects every row, a NULL key is rejected unless the list
    is empty. Spark's own form of this predicate always broadcasts the list; this
    one is a plain anti join plus two counters of the list.
    """
    listed = right.select(F.col(right_key).alias("__listed"))
    facts = listed.agg(
        F.struct(F.count("*").alias("n"), F.count_if(F.col("__listed").isNull()).alias("n_null"))
    )
    fact = facts.scalar()
    keep = (fact["n"] == 0) | ((fact["n_null"] == 0) & F.col(key).isNotNull())
    return left.where(keep).join(listed, F.col(key) == F.col("__listed"), "left_anti")


def unmatched_or_null(
    left: DataFrame, key: str, right: DataFrame, right_key: str, tested: str
) -> DataFrame:
    """``LEFT JOIN ... WHERE right.tested IS NULL`` without multiplying rows.

    Keeps left rows without a match and those that match a row whose ``tested``
    is itself NULL. One flag per right key stands in for the right rows.
    """
    flags = right.groupBy(F.col(right_key).alias("__key")).agg(
        F.bool_or(F.col(tested).isNull()).alias("__null_seen")
    )
    joined = left.join(flags, F.col(key) == F.col("__key"), "left")
    return joined.where(F.coalesce(F.col("__null_seen"), F.lit(True))).drop("__key", "__null_seen")


#: Words of a code that its anchor and the words beside that always cover.
SETTLED_WORDS = 3


def _pairs(words: str, prefix: str) -> Column:
    """Every two words that follow each other, with their place and the words beside them."""
    named = {"before": -1, "first": 0, "second": 1, "after": 2}
    # A single word makes a sequence that runs backwards; no pair comes of it.
    places = F.when(F.size(words) > 1, F.sequence(F.lit(0), F.size(words) - 2))
    return F.transform(places, lambda i: F.struct(i.alias(f"{prefix}at"), *(F.get(words, i + d).alias(prefix + name) for name, d in named.items())))


def _anchored(codes: DataFrame) -> DataFrame:
    """Per code ``__phrase`` of several words (``__of``) the pair of words it is anchored on: the one that fewest codes hold.

    What a place in a text can meet is kept small, and nothing of the texts has to be counted first.
    """
    spread = codes.select("__phrase", F.size("__of").alias("__n"), F.inline(_pairs("__of", "__c_")))
    held = spread.groupBy("__c_first", "__c_second").agg(F.count("*").alias("__codes"))
    rarest = F.min(F.struct("__codes", "__c_at", "__c_before", "__c_first", "__c_second", "__c_after", "__n")).alias("__rarest")
    chosen = spread.join(held, ["__c_first", "__c_second"]).groupBy("__phrase").agg(rarest)
    return chosen.select("__phrase", "__rarest.*")


def _met(texts: DataFrame, codes: DataFrame, small: bool) -> DataFrame:
    """Codes of several words, and the places of texts where their anchor and the words beside it stand."""
    places = texts.select("__id", F.inline(_pairs("__words", "__t_")))
    same = lambda name: F.col(f"__c_{name}") == F.col(f"__t_{name}")
    fits = same("first") & same("second") & (F.col("__c_before").isNull() | same("before")) & (F.col("__c_after").isNull() | same("after"))
    anchored = _anchored(codes)
    return places.join(anchored.hint("broadcast") if small else anchored, fits)


def _measured(codes: DataFrame) -> tuple[bool, int]:
    """Whether codes of words may be broadcast, by their measured size, and the number of words of the longest.

    Spark has no size of them before it plans, so it would shuffle every place of the texts to meet them.
    """
    spark = codes.sparkSession
    # A code's words, its anchor and what a row takes beside.
    row = 4 * F.octet_length("__phrase") + 32 * F.size("__of") + 256
    facts = codes.agg(F.sum(row).alias("bytes"), F.max(F.size("__of")).alias("longest")).first()
    small = (facts["bytes"] or 0) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return small, facts["longest"] or 0


def contains_words(left: DataFrame, code: str, right: DataFrame, text: str) -> DataFrame:
    """Left rows whose code stands between blanks in some right text.

    Same result as a nested loop over ``' ' + text + ' ' LIKE '% ' + code + ' %'``. A code of one word is looked up among
    the words of the texts. A longer one is anchored on the rarest pair of words in it, so a text is asked only
    for codes whose pair it has, at the places where it has it; the words beside the pair are compared right
    there, as part of the equality join. That settles codes of up to three words. A longer one is compared as
    a whole in the texts that have got so far. No run of words is ever written out. The codes are measured first (one
    short job): where they are below the session's threshold they are broadcast and no word of a text is shuffled, and
    where none is longer than three words no text is asked twice.
    """
    codes = left.where(F.col(code).isNotNull()).select(F.col(code).alias("__phrase")).distinct()
    codes = codes.select("__phrase", F.split("__phrase", " ").alias("__of"))
    texts = right.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__id"), F.split(text, " ").alias("__words"))
    n = F.size("__of")
    words = texts.select(F.explode(F.array_distinct("__words")).alias("__phrase"))
    small, longest = _measured(codes)
    ones = codes.where(n == 1).select("__phrase")
    single = words.join(ones.hint("broadcast") if small else ones, "__phrase").distinct()
    settled = _met(texts, codes.where((n > 1) & (n <= SETTLED_WORDS)), small).select("__phrase").distinct()
    phrases = single.unionByName(settled)
    if longest > SETTLED_WORDS:
        phrases = phrases.unionByName(_compared(texts, codes.where(n > SETTLED_WORDS), small))
    return left.join(phrases, F.col(code) == F.col("__phrase")).drop("__phrase")


def _compared(texts: DataFrame, codes: DataFrame, small: bool) -> DataFrame:
    """Codes that stand as a whole where their anchor is met."""
    open_ones = _met(texts, codes, small).select("__id", "__phrase", (F.col("__t_at") - F.col("__c_at")).alias("__from"), "__n")
    # Texts with one hash are all looked at, so a clash of hashes changes nothing.
    whole = texts.join(open_ones.where("__from >= 0").distinct(), "__id")
    same = F.array_join(F.slice("__words", F.col("__from") + 1, F.col("__n")), " ") == F.col("__phrase")
    return whole.where(same).select("__phrase").distinct()
