"""Datasets about feeds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.text import distinct_text_agg, joined_or_null
from ledgermatch.operators.lookup import unmatched_or_null
from ledgermatch.operators.pairing import linked
from ledgermatch.operators.rollup import Rollup, attach, distinct_ids, labels, list_distinct, roll_up
from ledgermatch.operators.snapshot import in_latest
from ledgermatch.plans import constants as const

Relations = Mapping[str, DataFrame]


def feed_to_source_code(rel: Relations) -> DataFrame:
    """Mapping of feeds to source codes in the latest snapshot."""
    return in_latest(rel["ucdp_feed_to_sc"], rel["t_dm_in_data_snapshot"], const.FEEDS, const.ALL_DATA).select(
        "feed_code", "source_code", "snapshot_id"
    )


def feeds(rel: Relations) -> DataFrame:
    """One row per feed and snapshot over its instances.

    Flags come from the instance with the greatest index, texts are collected
    over all instances. One shuffle: every aggregate combines on the map side.
    """
    flags = ["isnative", "isinternal", "feedid", "visibility", "state", "copyrightOwner"]
    texts: dict[str, Column] = {
        "description": F.col("description"),
        "parser": F.col("parser"),
        "parser_descr": joined_or_null(const.CODE_AND_TEXT, F.col("parser"), F.col("parser_descr")),
        "onboarder": F.col("onboarder"),
        "onboarder_descr": joined_or_null(const.CODE_AND_TEXT, F.col("onboarder"), F.col("onboarder_descr")),
    }
    keys = ["feed_code", "snapshot_id"]
    grouped = rel["ucdp_v_feed"].groupBy(*keys).agg(
        F.max(F.struct("feed_index", *flags)).alias("last"),
        *[distinct_text_agg(text, const.VARIANTS).alias(name) for name, text in texts.items()],
        F.count("feed_index").alias("feed_instance_count"),
    )
    # Instances are looked up by equality, so a NULL key finds none of them.
    known = F.col("feed_code").isNotNull() & F.col("snapshot_id").isNotNull()

    def looked_up(value: Column, name: str) -> Column:
        return F.when(known, value).alias(name)

    flag = {c: looked_up(F.col(f"last.{c}"), c) for c in flags}
    text = {c: looked_up(F.col(c), c) for c in texts}
    return grouped.select(
        "feed_code",
        flag["isnative"], flag["isinternal"], flag["feedid"], flag["visibility"], flag["state"],
        text["description"],
        flag["copyrightOwner"],
        text["parser"], text["parser_descr"], text["onboarder"], text["onboarder_descr"],
        "feed_instance_count",
        "snapshot_id",
    )


def _feed_sources(rel: Relations, columns: list[str]) -> DataFrame:
    """Distinct source-code columns per feed of the same consolidation.

    Feeds only filter here, so they are a semi join after the distinct step.
    """
    mapped = rel["t_mapped_source_code"].select("mnemonic", "consolidation_id", *columns)
    used = rel["ucdp_v_feed_to_sc"].select("feed_code", F.col("source_code").alias("mnemonic_used")).distinct()
    return (
        used.join(mapped, used["mnemonic_used"] == mapped["mnemonic"])
        .select("feed_code", "mnemonic", *[c for c in columns], "consolidation_id")
    )


def _of_known_feeds(rel: Relations, df: DataFrame) -> DataFrame:
    keys = ["feed_code", "consolidation_id"]
    return df.join(rel["t_feeds"].select(*keys), keys, "left_semi").select(*df.columns)


def feed_content_collection(rel: Relations) -> DataFrame:
    found = _feed_sources(rel, ["content_collection_id"]).drop("mnemonic").distinct()
    return _of_known_feeds(rel, found).select("feed_code", "content_collection_id", "consolidation_id")


def feed_source_code(rel: Relations) -> DataFrame:
    found = _feed_sources(rel, ["source_code", "name", "content_collection_id"]).distinct()
    return _of_known_feeds(rel, found).select(
        "feed_code",
        "source_code",
        F.col("mnemonic").alias("sc_mnemonic"),
        F.col("name").alias("sc_name"),
        F.col("content_collection_id").alias("sc_content_collection_id"),
        "consolidation_id",
    )


def _feed_reference(rel: Relations, kind: str) -> DataFrame:
    """Ids of one kind of reference per feed, through the feed's codes.

    Codes are resolved to distinct ids before they meet the feeds, so repeated
    relations and repeated labels do not multiply the large join. Labels are
    looked up first: the list of them is short and the lookup keeps its rows.
    The ids are the short side of the large join, so that the feeds' codes needn't be sorted. What a task finds for a
    feed then travels as a set of ids.
    """
    named = rel[f"nsa_v_code_{kind}"].select("code", F.col(kind).alias("label"), "consolidation_id")
    ids = rel[f"t_ref_{kind}"].select(F.col(kind).alias("label"), F.col("id").alias(f"{kind}_id"), "consolidation_id").distinct()
    code_ids = named.join(ids, ["label", "consolidation_id"]).select("code", f"{kind}_id", "consolidation_id").distinct()
    codes = rel["t_feed_codes"].select("feed_code", "code", "consolidation_id").distinct()
    found = codes.join(code_ids.hint("shuffle_hash"), ["code", "consolidation_id"])
    return distinct_ids(found, ["feed_code", "consolidation_id"], f"{kind}_id").select("feed_code", f"{kind}_id", "consolidation_id")


def feed_country(rel: Relations) -> DataFrame:
    return _feed_reference(rel, "country")


def feed_industry(rel: Relations) -> DataFrame:
    return _feed_reference(rel, "industry")


def feed_region(rel: Relations) -> DataFrame:
    return _feed_reference(rel, "region")


def feed_to_codes(rel: Relations) -> DataFrame:
    """Source codes of feeds, and the product codes those lead to.

    The many-to-many step is dealt by feed: the products of a source make longer lists than its feeds. The two kinds of code
    never share a row.
    """
    sources = rel["t_feed_source_code"].select("source_code", "feed_code", "consolidation_id")
    pairs = rel["t_product_code_source_code"].select("product_code", "source_code", "consolidation_id")
    products = linked(pairs, "product_code", sources, "feed_code", ["source_code", "consolidation_id"], ["consolidation_id"])

    def arm(df: DataFrame, code: str, code_type: str) -> DataFrame:
        return df.select(F.col(code).alias("code"), F.lit(code_type).alias("code_type"), "feed_code", "consolidation_id")

    return arm(sources.distinct(), "source_code", const.SOURCE).unionByName(arm(products, "product_code", const.PRODUCT))


def not_covered_feeds(rel: Relations) -> DataFrame:
    """Feeds mapped to unknown source codes, and feeds mapped to none.

    Reads the mapping of all snapshots, not only the latest.
    """
    mapping = rel["ucdp_feed_to_sc"]
    unknown = unmatched_or_null(
        mapping.where(F.col("feed_code").isNotNull()).select("feed_code", F.col("source_code").alias("__code")),
        "__code", rel["t_all_source_code"], "mnemonic", "source_code",
    )
    listed = roll_up(
        [labels(unknown, "SC", ["feed_code"], "__code")], ["feed_code"], [Rollup("SC", "codes", "n", const.LIST)]
    )
    # A feed is in this list because it has at least one unknown code.
    source_check = listed.select(
        F.col("feed_code").alias("Feed UCDP"),
        F.col("feed_code").alias("Feed To Source Code"),
        F.col("codes").alias("UCDP Source Code"),
        F.col("n").cast("string").alias("Count Source Codes mapped"),
        F.lit(const.SOURCE_CODE_CHECK).alias("Check Type"),
        F.lit(const.SOURCE_CODE_REASON).alias("Reason"),
    )
    unmapped = rel["t_feeds"].select("feed_code").join(mapping.select("feed_code"), "feed_code", "left_anti")
    feed_check = unmapped.select(
        F.col("feed_code").alias("Feed UCDP"),
        F.lit(None).cast("string").alias("Feed To Source Code"),
        F.lit("").alias("UCDP Source Code"),
        F.lit("").alias("Count Source Codes mapped"),
        F.lit(const.FEED_CHECK).alias("Check Type"),
        F.lit(const.FEED_REASON).alias("Reason"),
    )
    return source_check.unionByName(feed_check)


def feed_all_grouped(rel: Relations) -> DataFrame:
    """Feeds with all their codes and content collections.

    Product codes, by far the most, are listed by themselves, where they are if they are dealt by feed.
    """
    keys = ["feed_code", "consolidation_id"]
    sources = rel["t_feed_source_code"]
    collections = sources.select(*keys, F.col("sc_content_collection_id").alias("content_collection_id")).join(
        rel["t_content_collection"], "content_collection_id"
    )
    rolled = roll_up(
        [
            labels(sources, "SC", keys, "source_code"),
            labels(rel["t_feed_pe_code"], "PE", keys, "pe_code"),
            labels(collections, "CC", keys, "content_collection", identity="content_collection_id"),
        ],
        keys,
        [
            Rollup("SC", "sc", "sc_count", const.LIST),
            Rollup("PE", "pe_code", "pe_count", const.LIST),
            Rollup("CC", "content_collection", "cc_count", const.LIST),
        ],
    )
    products = list_distinct(rel["t_feed_product_code"], keys, "product_code", Rollup("PC", "pc", "pc_count", const.LIST))
    listed = attach(rel["t_feeds"], rolled, keys, ["sc_count", "pe_count", "cc_count"])
    return attach(listed, products, keys, ["pc_count"]).select(
        "feed_code", "description", "parser", "parser_descr", "onboarder", "onboarder_descr",
        "copyrightOwner", "sc", "sc_count", "pc", "pc_count", "pe_code", "pe_count",
        "content_collection", "cc_count", "feed_instance_count", "consolidation_id",
    )
