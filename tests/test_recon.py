"""Edge cases of the comparison of two sides."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgermatch.recon import diff, report
from ledgermatch.recon.diff import apply_mapping, differing_rows, except_rows, sample_rows, subtract
from ledgermatch.recon.spec import CheckSpec, CheckSuite
from ledgermatch.recon.suite import check_dataset, run_suite
from ledgermatch.recon.verdict import RESULT_SCHEMA, verdict

SCHEMA = "id int, name string, score double"
ROWS = [(1, "a", 1.5), (2, "b", None), (2, "b", None), (3, None, 0.1)]


def check(src, trg, **options):
    return verdict(src, trg, CheckSpec("d", **options)).first()


def outcome(row):
    return row["data"]["reason"], row["data"]["src_only_count"], row["data"]["trg_only_count"]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_equal_copies_in_another_order(spark, base):
    row = check(base, spark.createDataFrame(ROWS[::-1], SCHEMA))
    assert outcome(row) == ("Exact match", 0, 0)
    assert row["row_count_passed"] and row["columns"]["passed"] and row["columns"]["same_order"]


def test_repeated_row_changes_the_count_but_not_the_data(spark, base):
    row = check(base, spark.createDataFrame(ROWS[1:] + ROWS[:1] * 2, SCHEMA))
    assert (row["src_count"], row["trg_count"], row["row_count_passed"]) == (4, 5, False)
    assert outcome(row) == ("Exact match", 0, 0)
    tags = report.summary(verdict(base, base.union(base), CheckSpec("d"))).first()
    assert (tags["rows_count"], tags["data"], tags["status"]) == ("FAIL", "PASS", "FAIL")


def test_bag_mode_counts_surplus_copies(base):
    row = check(base, base.union(base), bag=True)
    assert outcome(row) == ("Data mismatch-EXCEPT ALL semantics", 0, 4)


def test_another_column_order_passes(base):
    row = check(base, base.select("score", "id", "name"))
    assert outcome(row) == ("Exact match", 0, 0)
    assert not row["columns"]["same_order"]


def test_null_is_not_the_empty_text_nor_its_mark(spark, base):
    for text in ("", "__NULL__"):
        trg = spark.createDataFrame([r if r[1] is not None else (3, text, 0.1) for r in ROWS], SCHEMA)
        assert outcome(check(base, trg)) == ("Data mismatch-EXCEPT semantics", 1, 1)


def test_nan_is_null(spark, base):
    trg = spark.createDataFrame([(a, b, math.nan if c is None else c) for a, b, c in ROWS], SCHEMA)
    assert outcome(check(base, trg)) == ("Exact match", 0, 0)


def test_types_are_compared_by_text(spark, base):
    text = base.select(F.col("id").cast("string").alias("id"), "name", "score")
    assert outcome(check(base, text)) == ("Exact match", 0, 0)
    wider = base.withColumn("id", F.col("id").cast("bigint"))
    assert outcome(check(base, wider)) == ("Exact match", 0, 0)
    fraction = base.withColumn("id", F.col("id").cast("double"))
    assert outcome(check(base, fraction)) == ("Data mismatch-EXCEPT semantics", 3, 3)


def test_column_mismatch_skips_the_data(base):
    row = check(base, base.withColumn("extra", F.lit(1)).drop("name"))
    assert outcome(row) == ("Skipped: column mismatch", None, None)
    assert row["columns"]["missing_in_trg"] == ["name"] and row["columns"]["missing_in_src"] == ["extra"]
    assert (row["src_count"], row["trg_count"]) == (4, 4)


def test_mapping_serves_both_sides(base):
    trg = base.withColumnRenamed("name", "NAME")
    for mapping in ({"NAME": "name"}, {"name": "NAME"}):
        assert outcome(check(base, trg, mapping=mapping)) == ("Exact match", 0, 0)
    assert outcome(check(base, trg))[0] == "Skipped: column mismatch"


def test_mapping_that_merges_columns_is_refused(base):
    with pytest.raises(ValueError, match="repeated column names"):
        apply_mapping(base, {"name": "score"})


def test_exclusion_follows_mapping_and_keeps_the_counts(spark, base):
    trg = base.select("id", F.upper("name").alias("NAME"), "score")
    row = check(base, trg, mapping={"NAME": "name"}, exclude=("name", "unknown"))
    assert outcome(row) == ("Exact match", 0, 0)
    merged = check(base.union(base), base.union(base), exclude=("name", "score"))
    assert (merged["src_count"], outcome(merged)) == (8, ("Exact match", 0, 0))


def test_empty_sides(spark, base):
    empty = base.where("false")
    both = check(empty, empty.drop("name"))
    assert outcome(both) == ("Skipping due to both datasets empty", None, None)
    assert both["row_count_passed"] and both["columns"]["same_order"] and not both["columns"]["passed"]
    one = check(base, empty)
    assert outcome(one) == ("Skipping due to one dataset empty", None, None)
    assert not one["row_count_passed"] and not one["columns"]["same_order"]
    assert one["columns"]["missing_in_trg"] == []


def test_nested_values_ignore_the_order_of_keys(spark):
    src = spark.sql("select 1 id, named_struct('b', 1, 'a', array('x', null)) doc")
    trg = spark.sql("select 1 id, named_struct('a', array('x', null), 'b', 1) doc")
    other = spark.sql("select 1 id, named_struct('a', array('x', 'y'), 'b', 1) doc")
    text = spark.sql("""select 1 id, '{"a": ["x", null], "b": 1}' doc""")
    assert outcome(check(src, trg))[0] == "Exact match"
    assert outcome(check(src, text))[0] == "Exact match"
    assert outcome(check(src, other)) == ("Data mismatch-EXCEPT semantics", 1, 1)
    maps = spark.sql("select 1 id, map('b', 1, 'a', 2) doc"), spark.sql("select 1 id, map('a', 2, 'b', 1) doc")
    assert outcome(check(*maps))[0] == "Exact match"


def test_repeated_column_names_are_refused(base):
    with pytest.raises(ValueError, match="repeated column names"):
        check(base.select("id", "id"), base)


def test_strange_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d e"])
    assert outcome(check(df, df))[0] == "Exact match"


def test_diff_equals_two_subtracts(spark):
    src = spark.range(50).selectExpr("id % 17 as a", "if(id % 5 = 0, null, id % 3) as b")
    trg = spark.range(40).selectExpr("id % 13 as a", "if(id % 4 = 0, null, id % 3) as b")
    diff = except_rows(src, trg)
    for side, expected in (("src", src.subtract(trg)), ("trg", trg.subtract(src))):
        got = {tuple(r) for r in diff.where(F.col("side") == side).drop("side").collect()}
        assert got == {tuple(r) for r in expected.collect()}
    assert {tuple(r) for r in subtract(src, trg).collect()} == {tuple(r) for r in src.subtract(trg).collect()}
    bag = except_rows(src, trg, bag=True).where("side = 'src'").drop("side")
    assert sorted(bag.collect(), key=str) == sorted(src.exceptAll(trg).collect(), key=str)


def test_samples_are_the_first_in_text_order(spark):
    src = spark.createDataFrame([(10, "x"), (9, None), (100, "y"), (1, "z")], "n int, t string")
    trg = spark.createDataFrame([(1, "z"), (9, "q")], "n int, t string")
    rows = [tuple(r) for r in sample_rows(src, trg, 2).orderBy("side", "rank").collect()]
    assert rows == [
        ("src", 1, '{"n":"10","t":"x"}'),
        ("src", 2, '{"n":"100","t":"y"}'),
        ("trg", 1, '{"n":"9","t":"q"}'),
    ]
    null = sample_rows(src.where("n = 9"), trg, 2).where("side = 'src'").first()
    assert null["row_json"] == '{"n":"9","t":"__NULL__"}'


class Sides:
    """Two dictionaries of frames as the inputs of a suite."""

    def __init__(self, src, trg):
        self.sides = {"src": src, "trg": trg}

    def missing(self, dataset):
        absent = [s for s, frames in self.sides.items() if dataset not in frames]
        return "; ".join(f"{s} file does not exist" for s in absent) or None

    def load(self, side, dataset):
        return self.sides[side][dataset]


def test_suite(spark, base):
    changed = base.withColumn("score", F.lit(0.0))
    source = Sides(
        {"same": base, "differs": base, "no_trg": base, "empty": base.where("false")},
        {"same": base, "differs": changed, "no_src": base, "empty": base.where("false")},
    )
    names = ["same", "differs", "no_trg", "no_src", "nowhere", "empty"]
    result = run_suite(spark, source, CheckSuite(lists={"data_list": names}, sample_diff_rows=1))
    rows = [tuple(r) for r in result.summary.collect()]
    assert rows == [
        ("same", "PASS", "PASS", "PASS", "PASS"),
        ("differs", "PASS", "PASS", "FAIL", "FAIL"),
        ("no_trg", "-ER-", "-ER-", "-ER-", "-ER-"),
        ("no_src", "-ER-", "-ER-", "-ER-", "-ER-"),
        ("nowhere", "-ER-", "-ER-", "-ER-", "-ER-"),
        ("empty", "NULL", "NULL", "NULL", "-ER-"),
    ]
    assert tuple(result.totals.first()) == (1, 1, 4)
    assert [(r["name"], r["side"], r["rank"]) for r in result.samples.collect()] == [
        ("differs", "src", 1),
        ("differs", "trg", 1),
    ]
    messages = {r["name"]: r["error_message"] for r in result.results.collect()}
    assert messages["nowhere"] == "src file does not exist; trg file does not exist"
    assert messages["no_trg"] == "trg file does not exist"


def test_status_rule(spark):
    cases = {
        ("PASS", "PASS", "PASS"): "PASS",
        ("FAIL", "PASS", "PASS"): "FAIL",
        ("PASS", "FAIL", "FAIL"): "FAIL",
        ("-ER-", "-ER-", "-ER-"): "-ER-",
        ("FAIL", "-ER-", "PASS"): "-ER-",
        ("NULL", "NULL", "NULL"): "-ER-",
        ("NULL", "PASS", "PASS"): "FAIL",
        ("PASS", "NULL", "PASS"): "-ER-",
    }
    df = spark.createDataFrame(list(cases), "a string, b string, c string")
    got = df.select("a", "b", "c", report.status(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert {tuple(r)[:3]: r[3] for r in got} == cases


def test_verdict_schema(spark, base):
    assert verdict(base, base, CheckSpec("d")).schema.simpleString() == spark.createDataFrame(
        [], RESULT_SCHEMA
    ).schema.simpleString()
    assert isinstance(check(base, base), Row)


@pytest.mark.parametrize("bag", [False, True])
def test_digests_give_the_same_verdict_and_samples(spark, base, bag):
    rows = [(1, "a", -0.0), (2, '{"c1":"b"}', None), (3, None, float("nan")), (3, "", 0.0), (1, "a", 0.0)]
    src = base.union(spark.createDataFrame(rows, SCHEMA))
    trg = base.union(spark.createDataFrame(rows[1:] + rows[3:4] + [(9, "z", 2.0)], SCHEMA))
    plain, digest = (check(src, trg, bag=bag, digest=d) for d in (False, True))
    assert plain == digest and outcome(plain)[2] >= 1
    expected = sample_rows(src, trg, 5, bag).orderBy("side", "rank").collect()
    assert sample_rows(*differing_rows(src, trg, bag), 5, bag).orderBy("side", "rank").collect() == expected


def test_digests_see_microseconds_and_every_type(spark):
    columns = "timestamp_ntz'2024-01-02 03:04:05.{0}' n, timestamp'2024-01-02 03:04:05.{1}' z, X'0{2}' b, 1.{3}BD d, 0.1D + {4} f"
    base = [100001, 200001, 1, 10, 0]
    src = spark.sql("select " + columns.format(*base))
    assert check(src, src, digest=True)["data"]["passed"]
    for i in range(len(base)):
        other = spark.sql("select " + columns.format(*[v + 1 if i == j else v for j, v in enumerate(base)]))
        assert check(src, other, digest=True)["data"]["src_only_count"] == 1


def test_bag_emits_every_surplus_copy(spark):
    src = spark.range(35_003).select(F.lit("x").alias("v")).union(spark.sql("select 'y' v"))
    trg = spark.range(3).select(F.lit("x").alias("v"))
    counts = except_rows(src, trg, bag=True).groupBy("side", "v").count().collect()
    assert sorted(tuple(r) for r in counts) == [("src", "x", 35_000), ("src", "y", 1)]


def test_data_columns_may_have_the_names_of_the_report(spark):
    schema = "side string, rank int, row_json string, surplus int"
    src = spark.createDataFrame([("R", 1, "x", 1), ("S", 2, "y", 2), ("S", 2, "y", 2)], schema)
    trg = spark.createDataFrame([("Q", 1, "x", 1), ("S", 2, "y", 2)], schema)
    assert {tuple(r) for r in except_rows(src, trg).collect()} == {("src", "R", 1, "x", 1), ("trg", "Q", 1, "x", 1)}
    assert [tuple(r) for r in subtract(src, trg).collect()] == [("R", 1, "x", 1)]
    rows = {(r["side"], r["row_json"]) for r in sample_rows(src, trg, 3, bag=True).collect()}
    assert {(s, '"side":"' + v + '"' in j) for (s, j), v in zip(sorted(rows), "RSQ", strict=True)} == {("src", True), ("trg", True)}


def test_digest_agrees_with_rows_under_a_collation(spark):
    src = spark.createDataFrame([("A",)], "v string").selectExpr("v collate UTF8_LCASE as v")
    trg = spark.createDataFrame([("a",)], "v string").selectExpr("v collate UTF8_LCASE as v")
    reasons = {verdict(src, trg, CheckSpec("d", digest=d)).first()["data"]["reason"] for d in (False, True)}
    assert reasons == {"Exact match"}


def test_columns_that_differ_in_case_only_are_refused(spark):
    frame = spark.createDataFrame([(1, 2)], "x int, y int").toDF("A", "a")
    with pytest.raises(ValueError, match="case only"):
        verdict(frame, frame, CheckSpec("d"))


def test_surplus_copies_are_spread(spark):
    many = spark.range(100_000).selectExpr("1 AS v")
    diff = except_rows(many, many.limit(0), bag=True)
    assert diff.count() == 100_000
    assert diff.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_one_broken_dataset_is_an_error_verdict(spark):
    class Source:
        def missing(self, dataset):
            return None

        def load(self, side, dataset):
            if dataset == "broken":
                raise RuntimeError("no such thing\nat line 2")
            return spark.range(3 if side == "src" else 2)

    config = {"data_checks": {"data_list": ["broken", "fine"]}, "run_mode": {"debug": 0, "bag": ["fine"], "digest": True}}
    suite = CheckSuite.from_config(config)
    assert (suite.spec("fine").bag, suite.spec("fine").digest, suite.spec("other").bag) == (True, True, False)
    result = run_suite(spark, Source(), suite)
    found = {r["name"]: r for r in result.results.collect()}
    assert found["broken"]["error_message"] == "no such thing" and found["fine"]["src_count"] == 3
    assert result.samples.count() == 0
    config["run_mode"]["debug"] = 1
    assert run_suite(spark, Source(), CheckSuite.from_config(config)).samples.count() == 1


@pytest.mark.parametrize("bag", [False, True])
def test_one_pass_gives_verdict_and_samples(spark, tmp_path, bag):
    """With a folder, each row of either side is read once, and nothing is left behind."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    def side(rows):
        plain = spark.createDataFrame(rows, "a int, b string, c double")
        return plain.mapInPandas(counted, plain.schema).toDF("a b", "c.d", "__src_copie")

    src = [(i, f"t{i % 7}", None if i % 5 == 0 else float(i)) for i in range(300)] + [(1, "t1", 1.0)] * 3 + [(None, None, None)] * 2
    trg = [r for r in src if (r[0] or 0) % 50 != 7] + [(1000 + i, "new", 0.5) for i in range(4)]
    source = Sides({"x": side(src)}, {"x": side(trg)})
    spec = CheckSpec("x", sample_rows=5, bag=bag)
    expected = check_dataset(spark, source, spec)
    in_two, whole = read.value, len(src) + len(trg)
    got = check_dataset(spark, source, spec, str(tmp_path))
    assert got == expected and len(got[1]) == 9
    # Beside the one pass, a few rows may be read to see that no side is empty.
    assert in_two == 2 * whole and whole <= read.value - in_two < 1.5 * whole
    assert not list(tmp_path.iterdir())


def test_written_groups_are_all_that_is_read(spark, base, tmp_path):
    changed = base.withColumn("score", F.lit(0.5)).withColumn("none", F.lit(None))
    spec, own = CheckSpec("x"), base.withColumn("none", F.lit(None))
    groups = diff.written_groups(own, changed, str(tmp_path / "g"))
    assert diff.row_groups(own, changed).columns == groups.columns
    for df in (verdict(own, changed, spec, groups), diff.sample_rows(own, changed, 3, groups=groups)):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().toString()
        assert "Relation" in leaves and "LocalRelation" not in leaves and "LogicalRDD" not in leaves
    assert verdict(own, changed, spec, groups).first() == verdict(own, changed, spec).first()
    same = diff.written_groups(own, own, str(tmp_path / "s"))
    assert same.where("score is not null").count() == 0 and verdict(own, own, spec, same).first()["data"]["passed"]
