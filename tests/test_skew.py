"""A third of all rows under one key: results stay whole."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgermatch.operators.lookup import contains_words, not_in, unmatched_or_null
from ledgermatch.operators.rollup import Rollup, labels, list_all, roll_up
from ledgermatch.plans import Catalog
from ledgermatch.recon.spec import CheckSpec
from ledgermatch.recon.verdict import verdict

N = 30_000


@pytest.fixture(scope="module", autouse=True)
def large_join_settings(spark):
    """Joins as with large tables: shuffled, and split when a partition stands out."""
    values = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key in values:
        spark.conf.unset(key)


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 has a third of the rows, the others one to three each."""
    third = F.col("id") < N // 3
    return spark.range(N).select(
        F.when(third, 0).otherwise(F.col("id") % 10_000 + 1).alias("k"),
        F.format_string("L%05d", F.when(third, F.col("id") % 500).otherwise(F.col("id") % 7)).alias("label"),
    )


def test_rollup(skewed):
    rolled = roll_up([labels(skewed, "L", ["k"], "label")], ["k"], [Rollup("L", "t", "n")])
    hot = rolled.where("k = 0").first()
    assert hot["n"] == 500 and hot["t"] == ", ".join(f"L{i:05d}" for i in range(500))
    assert rolled.count() == skewed.select("k").distinct().count()


def test_verdict(skewed):
    row = verdict(skewed, skewed.where("k <> 0 or label <> 'L00003'"), CheckSpec("d")).first()
    assert (row["src_count"], row["trg_count"]) == (N, N - 20)
    assert (row["data"]["src_only_count"], row["data"]["trg_only_count"]) == (1, 0)


def test_anti_joins(spark, skewed):
    known = spark.range(1, 5001).select(F.col("id").alias("r"), F.lit("x").alias("v"))
    expected = skewed.where("k = 0 or k > 5000").count()
    assert unmatched_or_null(skewed, "k", known, "r", "v").count() == expected
    assert not_in(skewed, "k", known, "r").count() == expected


def test_words(spark, skewed):
    texts = skewed.select(F.concat_ws(" ", F.lit("HOT"), "label", F.col("k").cast("string")).alias("text"))
    codes = spark.createDataFrame([("HOT",), ("HOT L00499",), ("L00499 0",), ("L00499 1",), ("COLD",)], "code string")
    assert sorted(r[0] for r in contains_words(codes, "code", texts, "text").collect()) == ["HOT", "HOT L00499", "L00499 0"]


def test_feed_to_codes(spark):
    feeds = spark.range(3000).select(
        F.concat(F.lit("f"), "id").alias("feed_code"),
        F.when(F.col("id") < 1000, "HOT").otherwise(F.concat(F.lit("s"), "id")).alias("source_code"),
        F.lit(654).alias("consolidation_id"),
    )
    products = spark.range(300).select(
        F.concat(F.lit("p"), "id").alias("product_code"),
        F.when(F.col("id") < 100, "HOT").otherwise(F.concat(F.lit("s"), F.col("id") + 2000)).alias("source_code"),
        F.lit(654).alias("consolidation_id"),
    )
    result = Catalog({"t_feed_source_code": feeds, "t_product_code_source_code": products})["nsa_v_feed_to_codes"]
    assert result.where("code_type = 'NS'").count() == 3000
    assert result.where("code_type = 'NP'").count() == 1000 * 100 + 200


def test_news_map_does_not_multiply_rows_in_the_join(spark):
    """One product, many repeated permission and language rows: one cell holds them all."""
    snapshots = spark.createDataFrame(
        [(1, "S:RDS", "RDS_PRODUCTS", "Y"), (2, "S:PS2", "PE_PDP", "Y")],
        "snapshot_id int, supplier_id string, data_type string, latest string",
    )
    products = spark.createDataFrame(
        [("NP:a", "A", "x", 0, 0, 1)] * 3,
        "product_code string, product_name string, source_codes string, not_product_code int, exclude_from_eikon int, snapshot_id int",
    )
    facts = spark.createDataFrame(
        [("NP:a", "NP", "RUN_PE", "7", 1)] * 40 + [("NP:a", "NP", "LANGUAGE", v, 1) for v in ("en", "fr", "en", None)],
        "code string, code_type string, data_type string, value string, snapshot_id int",
    )
    fees = spark.createDataFrame([("7", "P", 2)] * 5, "pe_code string, pdp_code string, snapshot_id int")
    packages = spark.createDataFrame([("P", "Specialist", "O", 2)], "pdp_code string, pdp_type string, owner string, snapshot_id int")
    row = Catalog(
        {"t_dm_in_data_snapshot": snapshots, "rds_product_code": products, "rds_reference_data": facts, "t_ps2_pdp_pe": fees, "t_ps2_pdp": packages}
    )["nsa_v_news_map"].first()
    copies = 3 * 40 * 5
    assert row["language"] == ",".join([""] * copies + ["en"] * 2 * copies + ["fr"] * copies)
    assert row["commercial_status"] == "Fee Liable"


def test_list_with_repeats(skewed):
    """Ten thousand rows of one key travel as their five hundred distinct values."""
    listed = list_all(skewed, ["k"], "label", ",", "t")
    hot = listed.where("k = 0").first()["t"].split(",")
    assert hot == [f"L{i:05d}" for i in range(500) for _ in range(20)]
    assert listed.count() == skewed.select("k").distinct().count()
