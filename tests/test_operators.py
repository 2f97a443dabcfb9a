"""Operators against brute force on small inputs."""

from __future__ import annotations

import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.combine import combinations
from ledgermatch.operators.lookup import (
    contains_words,
    left_with,
    left_with_existing,
    not_exists,
    not_in,
    unmatched_or_null,
)
from ledgermatch.operators.pairing import SEPARATOR, linked, linked_and
from ledgermatch.operators.rollup import Rollup, attach, distinct_ids, labels, last_row, list_all, list_distinct, list_limited, roll_up
from ledgermatch.operators.snapshot import at_latest, in_latest, write_consolidation


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("listed", [[1, 2], [1, None], [], [None], [7]])
def test_not_in(spark, listed):
    left = spark.createDataFrame([(v,) for v in (1, 2, 3, None)], "k int")
    right = spark.createDataFrame([(v,) for v in listed], "v int")
    left.createOrReplaceTempView("ni_left")
    right.createOrReplaceTempView("ni_right")
    expected = spark.sql("select k from ni_left where k not in (select v from ni_right)")
    got = not_in(left, "k", right, "v")
    assert values(got) == values(expected)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_left_joins_keep_left_rows(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "x")], "r int, v string")
    allowed = spark.createDataFrame([("x",), (None,)], "a string")
    assert values(left_with(left, right, [("k", "r")], F.col("v") == "x")) == [(1, 1, "x"), (2, None, None), (None, None, None)]
    assert values(left_with_existing(left, right, [("k", "r")], allowed, [("v", "a")])) == [(1, 1, "x"), (2, None, None), (None, None, None)]
    assert values(not_exists(left, right, [("k", "r")])) == [(None,)]


def test_unmatched_or_null(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, None), (None, "n")], "r int, v string")
    got = unmatched_or_null(left, "k", right, "r", "v")
    assert values(got) == [(2,), (3,), (None,)]


def test_contains_words_against_nested_loop(spark):
    rng = random.Random(3)
    words = ["a", "b", "ab", "", "c"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(40)] + [None]
    codes = [" ".join(p) for n in (1, 2, 3) for p in itertools.product(words, repeat=n)] + [None, "zz"]
    left = spark.createDataFrame([(c,) for c in codes], "code string")
    right = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = sorted(
        c for c in codes if c is not None and any(t is not None and f" {c} " in f" {t} " for t in texts)
    )
    assert sorted(r[0] for r in contains_words(left, "code", right, "text").collect()) == expected
    assert contains_words(left.where("false"), "code", right, "text").count() == 0


def test_rollup_counts_entries_without_label(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 2, "x"), (1, 3, None), (2, 4, None)], "k int, id int, v string")
    rolled = roll_up([labels(df, "V", ["k"], "v", identity="id")], ["k"], [Rollup("V", "t", "n")])
    base = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    assert values(attach(base, rolled, ["k"], ["n"])) == [(1, "x, x", 3), (2, None, 1), (3, None, 0), (None, None, 0)]


def test_rollup_orders_numbers_as_numbers(spark):
    df = spark.createDataFrame([(1, 10), (1, 9), (1, 100), (1, 9)], "k int, v int")
    rolled = roll_up([labels(df, "V", ["k"], "v")], ["k"], [Rollup("V", "t", "n")])
    assert values(rolled) == [(1, "9, 10, 100", 3)]
    text = df.withColumn("v", F.col("v").cast("string"))
    assert values(roll_up([labels(text, "V", ["k"], "v")], ["k"], [Rollup("V", "t", "n")])) == [(1, "10, 100, 9", 3)]


def test_last_row_takes_null_as_lowest(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, None), (1, 4, "c"), (2, None, "d")], "k int, o int, v string")
    assert values(last_row(df, ["k"], "o", ["v"])) == [(1, None), (2, "d")]


def test_snapshots(spark):
    registry = spark.createDataFrame(
        [(1, "S", "A", "N"), (2, "S", "A", "Y"), (3, "S", "A", "Y"), (4, "T", "A", "Y")],
        "snapshot_id int, supplier_id string, data_type string, latest string",
    )
    df = spark.range(6).select(F.col("id").cast("int").alias("snapshot_id"))
    assert values(in_latest(df, registry, "S", "A")) == [(2,), (3,)]
    assert values(at_latest(df, registry, "T", "A")) == [(4,)]
    assert values(at_latest(df, registry, "U", "A")) == []
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        at_latest(df, registry, "S", "A").collect()


def test_write_consolidation_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    write_consolidation(spark.range(2), path, 653)
    write_consolidation(spark.range(5), path, 654)
    write_consolidation(spark.range(3), path, 654)
    counts = spark.read.parquet(path).groupBy("consolidation_id").count()
    assert values(counts) == [(653, 2), (654, 3)]


def test_numeric_labels_of_any_size_in_order(spark):
    from ledgermatch.operators.rollup import Rollup, labels, roll_up

    def listed(values, dtype):
        frame = spark.createDataFrame([(1, v) for v in values], f"k int, v {dtype}")
        return roll_up([labels(frame, "v", ["k"], "v")], ["k"], [Rollup("v", "text", "n")]).first()["text"]

    assert listed([2e33, 1e33], "double") == "1.0E33, 2.0E33"
    assert listed([1e-7, 2e-8], "double") == "2.0E-8, 1.0E-7"
    assert listed([10, 9, 2**62 + 1, 2**62], "bigint") == f"9, 10, {2**62}, {2**62 + 1}"


def test_decimal_labels_are_listed_in_numeric_order(spark):
    values = ["100000000000000000.01", "99999999999999999.99", "99999999999999999.98", "-100000000000000000.01", "-100000000000000000.02", "9.50", "10.00", "-0.01", "0.00"]
    for kind in ("decimal(25,2)", "decimal(38,20)"):
        df = spark.createDataFrame([("k", v) for v in values] * 2, "k string, v string").withColumn("v", F.col("v").cast(kind))
        listed = roll_up([labels(df, "v", ["k"], "v")], ["k"], [Rollup("v", "listed", "n")]).first()
        assert [Decimal(x) for x in listed["listed"].split(", ")] == sorted(map(Decimal, values)) and listed["n"] == len(values)


def test_long_codes_are_found_word_by_word(spark):
    text = "a b c d e f g a b c d x a b c d e"
    codes = ["a b c d e f g a", "b c d x a b", "c d e f", "c d e g", "a b c d e f g b", text, f"{text} y", "d x", "x", "", " ", "a  b", "g a b c d x a b c d e"]
    texts = spark.createDataFrame([(text,), ("a  b",), (None,), ("",)], "text string")
    left = spark.createDataFrame([(c,) for c in codes] + [(None,)], "code string")
    expected = sorted(c for c in codes if any(f" {c} " in f" {t} " for t in (text, "a  b", "")))
    assert sorted(r[0] for r in contains_words(left, "code", texts, "text").collect()) == expected


def test_combinations_are_those_of_left_joins(spark):
    rng = random.Random(9)
    rows = lambda n: [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b", "c", "d"])) for _ in range(n)]
    keys = spark.createDataFrame([(k,) for k in (None, 1, 2, 3, 4, 5)], "k int")
    attributes = [(spark.createDataFrame(rows(n), f"k int, v{n} string"), f"v{n}") for n in (12, 9, 0, 3)]
    expected = keys
    for frame, _ in attributes:
        expected = expected.join(frame, "k", "left")
    got = combinations(keys, "k", attributes)
    assert got.columns == expected.columns and values(got) == values(expected)


def test_a_hot_key_is_unfolded_by_many_tasks(spark):
    values_of = lambda name: (spark.range(100).select(F.lit(7).alias("k"), F.col("id").alias(name)), name)
    keys = spark.createDataFrame([(7,), (8,)], "k int")
    got = combinations(keys, "k", [values_of("a"), values_of("b"), values_of("c")])
    rows = got.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count("*").alias("n"), F.sum(F.hash("a", "b", "c").cast("long")).alias("h")).collect()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["n"] for r in rows) == 1_000_001 and max(r["n"] for r in rows) < 2 * 1_000_000 / tasks
    assert got.where("k = 7").distinct().count() == 1_000_000


def test_limited_lists(spark):
    """Equal to the cut of the whole list, for separators, limits, repeats, NULLs and long texts of any kind."""
    texts = ["", "", "", "b", "a" * 50, "a" * 50 + "x", "a" * 50 + "w", None, "é", "zz"] * 3 + [f"v{i:04d}" for i in range(300)]
    rows = [(1, t) for t in texts] + [(2, None), (3, ""), (3, ""), (None, "q"), (None, "p")] + [(4, "r")] * 40
    df = spark.createDataFrame(rows, "k int, v string")
    for sep in (", ", ",", ""):
        whole = {r.k: r.s for r in list_all(df, ["k"], "v", sep, "s").collect()}
        for limit in (1, 2, 7, 49, 51, 200, 1024):
            got = {r.k: r.s for r in list_limited(df, ["k"], "v", sep, "s", limit).collect()}
            assert got == {k: s and s[:limit] if s is not None else None for k, s in whole.items()}, (sep, limit)


def test_limited_lists_cut_before_the_shuffle(spark):
    df = spark.range(0, 200_000, 1, 4).select((F.col("id") % 1).alias("k"), F.col("id").cast("string").alias("v"))
    limited = list_limited(df, ["k"], "v", ",", "s", 1024)
    plan = limited._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # one before the shuffle by key and one after it
    assert limited.first().s == ",".join(sorted(str(i) for i in range(200_000)))[:1024]


def test_linked_pairs_are_those_of_a_plain_join(spark):
    left = spark.sql("select if(id % 7 = 0, null, 'f' || id) f, if(id < 600, 'hot', if(id % 5 = 0, null, 's' || id % 40)) s, id % 2 c from range(900)")
    left = left.union(left)
    right = spark.sql("select if(id % 6 = 0, null, 'p' || id % 30) p, if(id < 20, 'hot', if(id % 9 = 0, null, 's' || id % 40)) s, id % 2 c from range(300)")
    more = spark.sql("select 'p1' p, 1L c, 'f1' f union all select null, null, 'x' union all select 'f2', 0, null")
    plain = left.join(right, ["s", "c"]).select("p", "c", "f").distinct()
    found = linked(left, "f", right, "p", ["s", "c"], ["c"])
    assert found.columns == ["p", "c", "f"] and found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    both, expected = linked_and(more, left, "f", right, "p", ["s", "c"], ["c"]), plain.union(more).distinct()
    assert both.exceptAll(expected).isEmpty() and expected.exceptAll(both).isEmpty()


def test_texts_are_stacked_without_columns_of_numbers(spark):
    texts, numbers = spark.sql("select 1 k, 'b' v"), spark.sql("select 1 k, 10L v union all select 1, 9L")
    assert labels(texts, "T", ["k"], "v").columns == ["k", "kind", "label"]
    rolled = roll_up([labels(texts, "T", ["k"], "v")], ["k"], [Rollup("T", "t", "n"), Rollup("N", "u", "m")], apart=[labels(numbers, "N", ["k"], "v")])
    assert rolled.first() == (1, "b", 1, "9, 10", 2)


def test_lists_of_partners_travel_as_texts(spark):
    odd = [None, "", " ", "a", f"a{SEPARATOR}b", SEPARATOR, "é", "b"]
    left = spark.createDataFrame([(f, s) for s, some in enumerate([odd, odd[1:4], odd[3:5], odd[:2], odd[5:], ["", ""]]) for f in some], "f string, s int")
    right = spark.createDataFrame([(p, s) for p in ("p", None) for s in range(6)], "p string, s int")
    for partner, rows in (("f", left), ("n", left.select(F.length("f").alias("n"), "s"))):
        plain = rows.join(right, "s").select("p", "s", partner).distinct()
        found = linked(rows, partner, right, "p", ["s"], ["s"])
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
        more = plain.select("p", "s", partner).union(spark.createDataFrame([("q", 9, None)], plain.schema))
        both, expected = linked_and(more, rows, partner, right, "p", ["s"], ["s"]), plain.union(more).distinct()
        assert both.exceptAll(expected).isEmpty() and expected.exceptAll(both).isEmpty()
        assert ("array_join" in found._jdf.queryExecution().executedPlan().toString()) == (partner == "f")


@pytest.mark.parametrize("dtype", ["long", "int", "string", "double"])
def test_distinct_ids(spark, dtype):
    numbers = [None, 0, 1, 63, 64, 65, -1, -64, -65, 2**31 - 1, -(2**31)] + ([2**63 - 1, -(2**63)] if dtype == "long" else [])
    rows = [(k, kind, n) for k in ("a", None) for kind in ("X", "Y") for n in numbers if n != 1 or kind == "X"] * 2
    df = spark.createDataFrame(rows, "k string, kind string, n long").withColumn("n", F.col("n").cast(dtype))
    plain = df.select("k", "kind", "n").distinct()
    for found in (distinct_ids(df, ["k", "kind"], "n"), distinct_ids(df, ["k"], "n", ["X", "Y"]), distinct_ids(df, ["k"], "n", ["X", "Y", "Z"], deal=["k"])):
        assert found.schema["n"].dataType == df.schema["n"].dataType
        assert found.columns == plain.columns and found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()


def test_whole_numbers_travel_as_sets(spark):
    df = spark.range(40_000, numPartitions=4).select((F.col("id") % 10).alias("k"), (F.col("id") % 60).alias("n"))
    found = distinct_ids(df, ["k"], "n")
    assert found.count() == df.distinct().count() == 60
    assert "bit_or" in found._jdf.queryExecution().executedPlan().toString()


def test_list_distinct_is_a_roll_up_in_one_aggregate(spark):
    rows = [(k, v) for k in (1, 2, None) for v in ("b", "a", None, "", "é", "B")] * 2 + [(3, None), (4, "x")]
    for df in (spark.createDataFrame(rows, "k int, v string"), spark.sql("select * from values (1, 10L), (1, 9L), (1, 9L), (2, null) t(k, v)")):
        rollup = Rollup("T", "t", "n", "; ")
        plain, found = roll_up([labels(df, "T", ["k"], "v")], ["k"], [rollup]), list_distinct(df, ["k"], "v", rollup)
        assert found.schema["n"].dataType == plain.schema["n"].dataType and found.columns == plain.columns
        assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    dealt = spark.createDataFrame(rows, "k int, v string").repartition("k")
    assert list_distinct(dealt, ["k"], "v", rollup)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
