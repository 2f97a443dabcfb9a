"""Multi-party dialogues rendered from the view of each participant, in built-in expressions only.

For every participant of a conversation the dialogue is written out with that
speaker as ``assistant`` and everybody else as a user by name; the loss mask covers
what the assistant says. System turns belong to nobody and are shown to all.

A long dialogue is written in parts of ``PART_TURNS`` turns, so no conversation has
to fit one task: the turns of a conversation are numbered in order, part p holds those numbered
from p * PART_TURNS on, and the parts of a perspective, in order, are the whole dialogue. Numbers are found
in two levels, sums per range of the sorted turns and running sums within a range; repeated turns travel as one row with
their number, so a conversation of very many equal turns is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.llm.shared import materialise

PART_TURNS = 1024
#: Roles that are no participant.
SHARED_ROLES = ("system",)
UNNAMED = "unknown"

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _plain(text: Column) -> Column:
    """Text in which nothing can pass for a control mark."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _heading(role: Column, shared: Column, own: Column) -> Column:
    return F.concat(
        F.lit(OPEN),
        F.when(shared, role).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role)),
        F.lit("\n"),
    )


def _parts(turns: DataFrame, part_turns: int) -> DataFrame:
    """conv_id, part, turn, role, text and copies: how often each different turn stands in each part."""
    order = [F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    ranged = counted.repartitionByRange(F.col("conv_id"), *order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "turns")  # so that a range holds the same turns whoever asks
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("conv_id", "range").agg(F.sum("copies").alias("n"))
    sums = sums.select(F.col("conv_id").alias("of"), F.col("range").alias("its"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    upto = Window.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("here", F.coalesce(F.sum("copies").over(upto), F.lit(0)))
    placed = placed.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("range") == F.col("its")))
    first = F.col("earlier") + F.col("here")
    stop, start = first + F.col("copies"), F.col("part") * part_turns
    cut = placed.withColumn("part", F.explode(F.sequence(F.floor(first / part_turns), F.floor((stop - 1) / part_turns))))
    return cut.select("conv_id", "part", "turn", "role", "text", (F.least(stop, start + part_turns) - F.greatest(first, start)).alias("copies"))


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, perspective, part, n_turns, n_masked, rendered, mask.

    ``mask`` lists the code points of ``rendered`` that count for the loss as
    start:end (end exclusive), comma-joined: the assistant's words with their end mark.

    NULL role: a participant called ``unknown``, the same as one of that name; blanks in a name become ``_``, so
    names that differ in blanks only are one participant. NULL text: an empty turn. Turns without a number come last.
    NULL conv_id: one conversation. Turns with one number come in order of role and
    text; repeated rows are repeated turns. A conversation with system turns only has no
    perspective and gives no row.
    """
    role = F.regexp_replace(_plain(F.coalesce("role", F.lit(UNNAMED))), r"\s+", "_")
    turns = conversations.select("conv_id", "turn", role.alias("role"), _plain(F.col("text")).alias("text"))
    people = turns.where(~F.col("role").isin(*SHARED_ROLES)).select(F.col("conv_id").alias("of"), F.col("role").alias("perspective")).distinct()
    # Every part once, then a row of it for each participant.
    turn = F.struct(F.col("turn").isNull().alias("unnumbered"), "turn", "role", "text", "copies")
    parts = _parts(turns, part_turns).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    seen = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    shared = lambda t: t["role"].isin(*SHARED_ROLES)
    own = lambda t: ~shared(t) & (t["role"] == F.col("perspective"))
    told = lambda t: F.struct(t["text"].alias("text"), own(t).alias("own"), _heading(t["role"], shared(t), own(t)).alias("heading"))
    every = F.flatten(F.transform("turns", lambda t: F.array_repeat(told(t), t["copies"].cast("int"))))
    grouped = seen.select("conv_id", "perspective", "part", every.alias("said"))

    ended = lambda x: F.concat(x["text"], F.lit(CLOSE))
    rendered = F.array_join(F.transform("said", lambda x: F.concat(x["heading"], ended(x), F.lit("\n"))), "")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        head = state["at"] + F.length(x["heading"])
        tail = head + F.length(ended(x))
        span = F.concat(head.cast("string"), F.lit(":"), tail.cast("string"))
        return F.struct((tail + 1).cast("long").alias("at"), F.when(x["own"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return grouped.select(
        "conv_id",
        "perspective",
        "part",
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda x: x["own"])).cast("long").alias("n_masked"),
        rendered.alias("rendered"),
        F.array_join(F.aggregate("said", start, step, lambda s: s["spans"]), ",").alias("mask"),
    )
