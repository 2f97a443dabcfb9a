"""The shape of physical plans: shuffles, joins, scans."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from ledgermatch import workload
from ledgermatch.fixtures import RELATIONS, relations
from ledgermatch.operators.lookup import contains_words
from ledgermatch.operators.snapshot import greatest
from ledgermatch.plans import DATASETS, Catalog
from ledgermatch.recon.diff import except_rows, sample_rows
from ledgermatch.recon.spec import CheckSpec
from ledgermatch.recon.verdict import verdict
from ledgermatch.workload.checks import altered_orders


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """The input relations as plain Parquet tables, as they are on a cluster."""
    folder, tables = tmp_path_factory.mktemp("landed"), relations(spark, sf_dir)
    frames = {}
    for name in RELATIONS:
        tables[name].write.parquet(f"{folder}/{name}")
        frames[name] = spark.read.parquet(f"{folder}/{name}")
    return frames


def test_a_verdict_needs_one_shuffle_of_the_rows(orders):
    check = verdict(orders, altered_orders(orders), CheckSpec("orders"))
    assert exchanges(check) == 1
    # The grouping stays in hash aggregates and combines before the shuffle.
    text = plan(check)
    assert "SortAggregate" not in text and "SortMergeJoin" not in text
    assert text.rindex("partial_sum") > text.index("Exchange hashpartitioning")


def test_column_mismatch_reads_no_column(orders):
    text = plan(verdict(orders, orders.drop("o_custkey"), CheckSpec("orders")))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", text) == ["struct<>", "struct<>"]
    assert "Exchange hashpartitioning" not in text


def test_samples_share_one_shuffle(orders):
    df = sample_rows(orders, altered_orders(orders), 5)
    df.collect()
    assert "ReusedExchange" in plan(df) or plan(df).count("ShuffleQueryStage") > 1
    assert plan(df).count("TakeOrderedAndProject") >= 2


def test_filters_and_columns_reach_the_scan(orders):
    df = except_rows(
        orders.where("o_totalprice > 1000").select("o_orderkey"), orders.where("o_totalprice > 1000").select("o_orderkey")
    )
    text = plan(df)
    assert "GreaterThan(o_totalprice,1000.0)" in text
    assert "o_orderpriority" not in text


def test_greatest_version_is_a_scalar_subquery_on_the_scan(landed):
    table = landed["t_all_source_code"]
    df = table.where(F.col("consolidation_id") == greatest(table, "consolidation_id")).select("source_code")
    assert re.search(r"PushedFilters: \[[^\]]*consolidation_id", plan(df))
    assert "Join" not in plan(df)


@pytest.mark.parametrize("name", sorted(DATASETS))
def test_datasets_have_no_nested_loop_and_no_window(landed, name):
    text = plan(Catalog(landed)[name])
    for operator in ("BroadcastNestedLoopJoin", "CartesianProduct", "Window", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


@pytest.mark.parametrize(
    "name, most",
    [
        ("ucdp_v_feed_to_sc", 2),
        ("nsa_v_feeds", 1),
        ("nsa_v_feed_to_codes", 6),
        ("tmp_nsa_v_feed_all_grouped", 6),
        ("nsa_v_all_pc_ref_grouped", 12),
    ],
)
def test_number_of_shuffles(spark, landed, name, most):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert exchanges(Catalog(landed)[name]) <= most
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


#: Queries that write and read tables while they are built, so there is no one plan to look at.
_WRITING = {"landing_suite", "landing_json_log", "landing_json_nan", "landing_format_change", "materialised_feeds", "json_documents", "summary_sink"}


@pytest.mark.parametrize("name", sorted(set(workload.QUERIES) - _WRITING))
def test_no_query_compares_all_pairs(spark, sf_dir, name):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        text = plan(workload.QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_large_lists_are_never_forced_to_broadcast(spark, landed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("nsa_v_all_product_codes", "nsa_v_news_map_variant", "nsa_v_all_source_codes"):
            assert "Broadcast" not in plan(Catalog(landed)[name])
        texts = spark.createDataFrame([("a b",)], "text string")
        codes = spark.createDataFrame([("a",)], "code string")
        assert "Broadcast" not in plan(contains_words(codes, "code", texts, "text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shared_datasets_are_written_once_in_order(spark, sf_dir, tmp_path):
    from ledgermatch.fixtures import RELATIONS, relations
    from ledgermatch.plans import DATASETS, Catalog

    catalog = Catalog(relations(spark, sf_dir))
    names = ["nsa_v_all_sc_ref_grouped_1", "nsa_v_all_sc_ref_grouped_2", "nsa_v_news_map_variant"]
    graph = catalog.rests_on(names)
    assert set(names) <= set(graph) and "nsa_v_news_map" in graph["nsa_v_news_map_variant"]
    listed = list(graph)
    assert all(listed.index(o) < listed.index(n) for n in graph for o in graph[n] if o in DATASETS)
    done = catalog.materialised(str(tmp_path), [*names, "nsa_v_news_map"], inputs=True)
    written = {p.name for p in tmp_path.iterdir()}
    assert "nsa_v_news_map" in written and "nsa_v_news_map_variant" not in written and written <= set(DATASETS) | set(RELATIONS)
    for name in names:
        assert done[name].exceptAll(catalog[name]).isEmpty() and done[name].count() == catalog[name].count()


def test_feed_codes_are_in_place_for_the_join_on_their_code(spark, sf_dir):

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        rel = relations(spark, sf_dir)
        join = workload.QUERIES["join_inner_composite"](spark, sf_dir)
        named = rel["nsa_v_code_industry"].select("code", "industry", "consolidation_id").distinct()
        # The ids may be dealt once more; the feeds' codes are not.
        assert exchanges(join) <= exchanges(rel["t_feed_codes"]) + exchanges(named) + 1
        products = exchanges(rel["t_feed_product_code"])
        assert exchanges(rel["t_feed_product_code"].select("product_code", "consolidation_id", "feed_code").distinct()) == products
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_short_codes_ask_no_text_twice(spark):
    texts = spark.createDataFrame([("a b c d e",)], "text string")
    short, long = (spark.createDataFrame([(c,)], "code string") for c in ("b c d", "b c d e"))
    found = contains_words(short, "code", texts, "text")
    assert found.count() == 1 and contains_words(long, "code", texts, "text").count() == 1
    assert "xxhash64(text" not in plan(found) and "Exchange hashpartitioning(__t_first" not in plan(found)


def test_row_counts_write_no_input(spark, sf_dir, tmp_path, monkeypatch):
    from ledgermatch.workload import estate

    monkeypatch.setattr(estate, "_shared_folder", lambda spark: str(tmp_path))
    estate.qa_row_counts(spark, sf_dir)
    assert not {p.name for p in tmp_path.iterdir()} & set(RELATIONS)


def _shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|")
    return {f for f in files.split("|") if "/shuffle_" in f}


def test_row_counts_leave_no_shuffle_behind(spark, sf_dir):
    from ledgermatch.workload import estate

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = _shuffle_files(spark), spark.conf.get(key, None)
    counted = estate.qa_row_counts(spark, sf_dir)
    for _ in range(20):  # files are removed in the background
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(key, None) == setting
    assert "Join" not in plan(counted) and {r.view_name for r in counted.collect()} == set(DATASETS)


def test_ids_of_feeds_travel_as_sets(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for kind in ("country", "region", "industry"):
            assert "bit_or" in plan(Catalog(relations(spark, sf_dir))[f"nsa_v_feed_{kind}"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_labels_of_references_are_listed_where_the_codes_were_dealt(spark, sf_dir):
    listed = plan(Catalog(relations(spark, sf_dir))["nsa_v_all_pc_ref_grouped"])
    lists = next(line for line in listed.splitlines() if "listagg" in line)
    assert "bit_or" in listed and "partial_listagg" not in lists
    below = listed[listed.index("partial_listagg") :]
    # The join with the labels comes next, not a shuffle of lists.
    assert "Exchange" not in listed[listed.index("listagg") : listed.index("partial_listagg")] and "Join" in below


def test_products_of_feeds_are_listed_in_place(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        products, keys = relations(spark, sf_dir)["t_feed_product_code"], ["feed_code", "consolidation_id"]
        assert exchanges(products.groupBy(*keys).count()) == exchanges(products)
        assert "collect_set(product_code" in plan(Catalog(relations(spark, sf_dir))["tmp_nsa_v_feed_all_grouped"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_truncated_lists_are_compared_without_a_shuffle_of_list_entries(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        text = plan(workload.QUERIES["recon_truncated_lists"](spark, sf_dir))
        sent = [below for line, below in zip(text.splitlines(), text.splitlines()[1:], strict=False) if "Exchange" in line]
        assert "collect_set(product_code" in text and not any("collect_set(product_code" in line for line in sent)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("name", ["t_product_code_source_code", "t_ref_data_relations", "t_feed_product_code", "t_feed_codes"])
def test_built_relations_hold_the_rows_of_their_query_on_odd_tables(spark, tmp_path, name):
    from ledgermatch.fixtures import BUILT, for_spark, needed

    n = 60
    spark.sql(f"select id c_custkey, 'c'||id c_name, 'M' c_mktsegment, id%3 c_nationkey, id-20.0 c_acctbal from range({n})").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.sql(f"select if(id%13=0,null,id%90) o_orderkey, if(id%11=0,null,id%{n}) o_custkey from range(200)")
    orders.union(orders).write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.sql("select if(id%17=0,null,id%90) l_orderkey, if(id%19=0,null,id%40) l_partkey, if(id%7=0,null,id%5) l_suppkey from range(500)")
    lines.union(lines.limit(90)).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id event_id, if(id%23=0,null,id%30) user_id, 'view' event_type from range(400)").write.parquet(f"{tmp_path}/events.parquet")
    rel = relations(spark, str(tmp_path))
    for table in ("customer", "orders", "lineitem", "events"):
        rel[table].createOrReplaceTempView(table)
    for other in needed([name]):
        spark.sql(for_spark(RELATIONS[other])).createOrReplaceTempView(other)
    plain = spark.sql(for_spark(RELATIONS[name]))
    built = BUILT[name](rel)
    assert [(f.name, f.dataType) for f in built.schema] == [(f.name, f.dataType) for f in plain.schema] and plain.count() > 50
    assert built.exceptAll(plain).isEmpty() and plain.exceptAll(built).isEmpty()


def test_product_and_source_pairs_are_neither_sorted_nor_made_distinct_at_the_end(spark, sf_dir):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        text = plan(workload.QUERIES["nsa_v_all_product_code_source_code"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in text and text.count("ShuffledHashJoin") == 4
    assert "HashAggregate" not in text[: text.index("ShuffledHashJoin")]


def test_product_and_source_pairs_with_repeats_and_nulls(spark):
    bpsa = [("S1", "P1"), ("S1", "P1"), ("S1", None), (None, "P1"), ("S2", "P2"), ("S9", "P1")]
    rcs = [("NP:P1", "NS:S1"), ("P2", "S1"), ("NP:P2", None), ("NP:P2", "NS:S2")]
    sources = [("NS:S1", "S1", 653), ("NS:S1", "S1", 653), ("NS:S1", "S1", 654), ("NS:X", "S1", 654), (None, "S2", 654), (None, "S2", 654), ("NS:N", None, 654), ("NS:S2", "S2", None)]
    products = [("NP:P1", "P1", 653), ("NP:P1", "P1", 654), ("NP:P1", "P1", 654), (None, "P2", 654), (None, "P2", 654), ("NP:P2", "P2", None)]
    rel = {
        "bpsa_v_product_code_source_code": spark.createDataFrame(bpsa, "source_code string, product_code string"),
        "rcs_v_product_code_source_code": spark.createDataFrame(rcs, "product_code string, source_code string"),
        "t_all_source_code": spark.createDataFrame(sources, "source_code string, mnemonic string, consolidation_id int"),
        "t_all_product_code": spark.createDataFrame(products, "product_code string, mnemonic string, consolidation_id int"),
    }
    bare = lambda x, prefix: x if x is None else x.removeprefix(prefix)
    pairs = {*bpsa, *((bare(s, "NS:"), bare(p, "NP:")) for p, s in rcs)}
    expected = {
        (p, s, pm, sm, c) for s, sm, c in sources for p, pm, d in products if c == d and c is not None and (sm, pm) in pairs and None not in (sm, pm)
    }
    rows = [tuple(r) for r in Catalog(rel)["nsa_v_all_product_code_source_code"].collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_pair_relations_hold_the_rows_of_their_query(spark, sf_dir):
    from ledgermatch.fixtures import BUILT, for_spark

    rel = relations(spark, sf_dir)
    for name in ("bpsa_v_product_code_source_code", "rcs_v_product_code_source_code"):
        for table in ("lineitem", "orders", "customer"):
            rel[table].createOrReplaceTempView(table)
        plain = spark.sql(for_spark(RELATIONS[name]))
        assert name in BUILT and rel[name].schema == plain.schema
        assert rel[name].exceptAll(plain).isEmpty() and plain.exceptAll(rel[name]).isEmpty()
