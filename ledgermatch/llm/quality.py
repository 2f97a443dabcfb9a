"""Quality rules with thresholds learnt per language and source.

Counts of a whole text become rates (symbols per word, repeated lines per line
and so on). For every (lang, source) and rate a quantile sketch is built; a
text is rejected when a rate lies beyond the fence that its own group's
quantiles give. No cutoff is fixed: a source of tables or code gets the room
that its own texts need.

The sketch keeps counts in logarithmic bins (relative error ``ACCURACY``), so two
sketches merge by adding counts: partial sums before the shuffle, groups of
few texts merged into their language and then into the whole, the same result in
any order. Only sums travel, never texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgermatch.llm.batches import PLAIN_WORD, Run, byte_class, mix, runs, windows
from ledgermatch.llm.shared import materialise

WINDOW_WORDS = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
_SYMBOLS, _CAPITALS, _MARKS = byte_class(b"#*$%&|<>"), byte_class(bytes(range(65, 91))), byte_class(b"!?")

#: Relative width of a bin of the sketch.
ACCURACY = 0.02
#: Texts that a (lang, source) needs for fences of its own; with fewer it takes those of its language, then of all.
OWN_FENCE_ROWS = 50


@dataclass(frozen=True)
class Rule:
    """Reject where ``rate`` > q75 + reach * (q98 - q75) + slack, or below the mirror image of it if ``low``.

    The room is the group's own: q98 is above zero as soon as one text in fifty has any of what the rate counts.
    ``slack`` only keeps a single symbol, or a rounded bin, from deciding.
    """

    name: str
    rate: str
    slack: float = 0.02
    reach: float = 1.5
    low: bool = False


RULES = [
    Rule("word_length", "word_chars / n_words", 1.0, low=True),
    Rule("symbols", "n_symbols / n_words"),
    Rule("dup_lines", "n_dup_lines / n_lines"),
    Rule("repeats", "n_repeat_words / n_words"),
    Rule("capitals", "n_capitals / word_chars"),
    Rule("marks", "n_marks / n_words"),
]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True for each key that occurs twice or more."""
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _counts(run: Run) -> list[np.ndarray]:
    data, bounds = run.data, run.bounds
    in_word = PLAIN_WORD[data]
    words = run.pieces(in_word)
    first = words.firsts()
    per_row = np.diff(first)
    chars = run.per_row(in_word & ((data & 0xC0) != 0x80))

    lines = run.lines()
    line_row = np.searchsorted(bounds, lines.starts, "right") - 1
    line_row = np.minimum(line_row, run.rows - 1)
    worded = np.searchsorted(words.starts, lines.stops) > np.searchsorted(words.starts, lines.starts)
    line_keys, line_row = lines.hashes()[worded], line_row[worded]
    with np.errstate(over="ignore"):
        line_keys = mix(line_keys + line_row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    n_lines = np.bincount(line_row, minlength=run.rows)
    _, once = np.unique(line_keys, return_index=True)
    n_dup = n_lines - np.bincount(line_row[once], minlength=run.rows)

    hashes = windows(words.hashes(), WINDOW_WORDS)
    n_repeat = np.zeros(run.rows, np.int64)
    if len(hashes):
        word_row = np.repeat(np.arange(run.rows), per_row)
        inside = np.flatnonzero(word_row[: len(hashes)] == word_row[WINDOW_WORDS - 1 :])
        with np.errstate(over="ignore"):
            keys = mix(hashes[inside] + word_row[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        hit = inside[_repeated(keys)]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[hit] += 1
        np.subtract.at(edge, hit + WINDOW_WORDS, 1)
        n_repeat = np.bincount(word_row[np.cumsum(edge[:-1]) > 0], minlength=run.rows)
    marks = [run.per_row(t[data]) for t in (_SYMBOLS, _CAPITALS, _MARKS)]
    return [per_row, chars, marks[0], n_dup, n_repeat, n_lines, marks[1], marks[2]]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts(text: pa.Array) -> pa.Array:
    """Counts of each whole text; NULL has no words."""
    parts = [_counts(run) for run in runs(text)] or [[np.empty(0, np.int64)] * len(COUNTS)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], COUNTS)


def base_failed(c: Column | None = None) -> Column:
    """The fixed floor: too few words, or too many of them in repeated windows."""
    n, r = (F.col("n_words"), F.col("n_repeat_words")) if c is None else (c["n_words"], c["n_repeat_words"])
    return (n < MIN_WORDS) | (F.lit(100) * r > F.lit(REPEAT_PERCENT) * n)


def _rate(rule: Rule) -> Column:
    """NULL where the divisor is zero."""
    over, under = rule.rate.split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under))


def sketches(measured: DataFrame) -> DataFrame:
    """Bin counts (lang, source, rule, bin, n) of texts that pass the base rules; bin NULL holds the zeros."""
    bin_of = F.when(F.col("rate") > 0, F.ceil(F.log(F.col("rate")) / math.log1p(ACCURACY)))
    rates = F.array(*(F.struct(F.lit(i).alias("rule"), _rate(r).alias("rate")) for i, r in enumerate(RULES)))
    return (
        measured.where(~base_failed())
        .select("lang", "source", F.inline(rates))
        .where("rate is not null")
        .groupBy("lang", "source", "rule", bin_of.alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """One sketch per value of ``keys`` out of any number of sketches: counts add up."""
    return sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Rows of keys, rule, rows and the quantiles q2, q25, q50, q75 and q98 of each sketch."""
    group = Window.partitionBy(*keys, "rule")
    upto = group.orderBy(F.col("bin").asc_nulls_first())
    value = F.when(F.col("bin").isNull(), 0.0).otherwise(F.pow(F.lit(1 + ACCURACY), F.col("bin")) * (2 / (2 + ACCURACY)))
    running = sketch.select(
        *keys, "rule", value.alias("value"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(group).alias("rows")
    )
    return running.groupBy(*keys, "rule").agg(
        F.max("rows").alias("rows"),
        *(F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("value"))).alias(f"q{round(100 * q)}") for q in (0.02, 0.25, 0.5, 0.75, 0.98)),
    )


def _fence(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per keys with an array of [low, high] by rule."""
    by_rule = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("rule") + 1)
    slack, reach = by_rule(r.slack for r in RULES), by_rule(r.reach for r in RULES)
    low = F.element_at(F.array(*(F.lit(r.low) for r in RULES)), F.col("rule") + 1)
    # A bin's value may be ACCURACY / 2 below or above those of its texts.
    high = (F.col("q75") + reach * (F.col("q98") - F.col("q75"))) * (1 + ACCURACY) + slack
    floor = F.when(low, (F.col("q25") - reach * (F.col("q25") - F.col("q2"))) * (1 - ACCURACY) - slack)
    return rows.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("rule", F.struct(floor.alias("low"), high.alias("high"))))).alias("fence"),
    )


def fences(measured: DataFrame) -> DataFrame:
    """Fences per (lang, source): its own, its language's or those of all texts, by the rows behind them."""
    own = materialise(sketches(measured), "sketch")
    by_lang = merge(own, "lang")
    a = _fence(quantiles(own, "lang", "source"), "lang", "source").alias("a")
    b = _fence(quantiles(by_lang, "lang"), "lang").alias("b")
    whole = _fence(quantiles(merge(by_lang))).first()  # one row: a pair of numbers per rule
    bounds = whole.fence if whole else {}
    pair = "struct<low:double,high:double>"
    default = F.create_map(
        *(x for k, v in bounds.items() for x in (F.lit(k), F.struct(F.lit(v.low).cast("double").alias("low"), F.lit(v.high).alias("high"))))
    ).cast(f"map<int,{pair}>")
    enough = lambda t: F.when(F.col(f"{t}.rows") >= OWN_FENCE_ROWS, F.col(f"{t}.fence"))
    return a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")), "left").select(
        F.col("a.lang").alias("fence_lang"),
        F.col("a.source").alias("fence_source"),
        F.coalesce(enough("a"), enough("b"), default).alias("fence"),
    )


def judged(docs: DataFrame, *carry: str) -> DataFrame:
    """Counts, base_failed and kept of each document, beside the columns ``carry``.

    The fences are one row per (lang, source), written first; the optimizer then
    broadcasts them if they are small and else joins by shuffle.
    A text whose group has no fence (all of it failed the base rules) has failed them too.
    """
    wanted = docs.select(*carry, "lang", "source", counts("text").alias("c"))
    flat = wanted.select(*carry, "lang", "source", "c.*")
    limit = materialise(fences(docs.select("lang", "source", counts("text").alias("c")).select("lang", "source", "c.*")), "fences")
    inside = F.lit(True)
    for i, rule in enumerate(RULES):
        fence, rate = F.col("fence")[F.lit(i)], _rate(rule)
        inside &= F.coalesce(rate <= fence["high"], F.lit(True))
        if rule.low:
            inside &= F.coalesce(rate >= fence["low"], F.lit(True))
    return (
        flat.join(limit, flat.lang.eqNullSafe(limit.fence_lang) & flat.source.eqNullSafe(limit.fence_source), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & inside)
        .drop("fence_lang", "fence_source", "fence")
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    NULL or empty text: no words, rejected. NULL lang or source: a group of its
    own. Repeated rows are judged alike. An empty table gives an empty table.
    """
    wide = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    return judged(wide, "row").where("kept").select("row.*")
