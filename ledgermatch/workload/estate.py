"""Queries over many datasets at once: counts, column lists, landing and suites."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermatch.fixtures import TABLES, relations
from ledgermatch.operators.snapshot import write_consolidation
from ledgermatch.plans import DATASETS, Catalog
from ledgermatch.qa import column_lists, row_counts, row_counts_apart, shuffles_removed
from ledgermatch.recon.diff import except_rows
from ledgermatch.recon.report import summary
from ledgermatch.recon.spec import CheckSpec, CheckSuite
from ledgermatch.recon.suite import run_suite
from ledgermatch.recon.verdict import verdict
from ledgermatch.sources.extract import FrameSource, extract
from ledgermatch.sources.landing import Landing, write_summary
from ledgermatch.workload.checks import altered_orders
from ledgermatch.workload.derived import ORACLE as DERIVED_SQL


def _shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares; only a local session may leave that out."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ledgermatch-")
    return f"{base.rstrip('/')}/landing-{uuid.uuid4().hex}"


def qa_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every derived dataset; derived datasets that several of them rest on are computed once."""
    with shuffles_removed(spark):
        catalog = Catalog(relations(spark, sf_dir)).materialised(_shared_folder(spark), DATASETS)
    return row_counts_apart(spark, catalog, DATASETS)


def qa_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table."""
    return row_counts(relations(spark, sf_dir), TABLES)


def qa_column_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every table, in order, next to its number of rows."""
    tables = relations(spark, sf_dir)
    return column_lists(spark, tables, TABLES).join(row_counts(tables, TABLES), "view_name")


def adhoc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read query with parameters over derived datasets and inputs."""
    return Catalog(relations(spark, sf_dir)).sql(
        spark,
        """
        SELECT s.content_collection_id, count(*) AS n_codes, count(DISTINCT f.feed_code) AS n_feeds
        FROM {nsa_v_mapped_source_code} s JOIN {nsa_v_feed_source_code} f
        ON f.source_code = s.source_code AND f.consolidation_id = s.consolidation_id
        WHERE s.consolidation_id = :consolidation AND s.status = :status
        GROUP BY s.content_collection_id
        """,
        {"consolidation": 654, "status": "ACTIVE"},
    )


def landing_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land two sides, check them as a suite, return the summary."""
    tables = relations(spark, sf_dir)
    data_dir = _shared_folder(spark)
    src = FrameSource({"orders": tables["orders"], "customer": tables["customer"], "part": tables["part"]})
    trg = FrameSource({"orders": altered_orders(tables["orders"]), "customer": tables["customer"], "part": tables["part"].drop("p_size")})
    names = ["orders", "customer", "part"]
    extract(spark, {"src": src, "trg": trg}, names, data_dir)
    suite = CheckSuite(lists={"data_list": [*names, "absent"]})
    return run_suite(spark, Landing(spark, data_dir), suite).summary


def landing_json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land JSON lines of both sides; the log counts what can be read back."""
    tables = relations(spark, sf_dir)
    sides = {
        "src": FrameSource({"orders": tables["orders"]}),
        "trg": FrameSource({"orders": altered_orders(tables["orders"])}),
    }
    log = extract(spark, sides, ["orders", "absent"], _shared_folder(spark), fmt="json")
    return log.select("side", "dataset", "rows", F.col("error").isNotNull().alias("failed"))


def materialised_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived dataset written as a consolidation, twice, and read back."""
    path = _shared_folder(spark)
    feeds = Catalog(relations(spark, sf_dir))["nsa_v_feeds"]
    for _ in range(2):  # a repeated run replaces its own rows
        write_consolidation(feeds, path, 655)
    return spark.read.parquet(path).select("feed_code", "snapshot_id", "feed_instance_count", "consolidation_id")


def recon_column_named_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of data that has a ``side`` column of its own."""
    src = relations(spark, sf_dir)["orders"].select("o_orderkey", F.col("o_orderstatus").alias("side"))
    trg = src.withColumn("side", F.when(F.col("o_orderkey") % 100 == 0, "Z").otherwise(F.col("side")))
    return except_rows(src, trg)


def recon_digest_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a collation makes equal: the same verdict from rows and in digest mode."""
    words = relations(spark, sf_dir)["customer"].select("c_custkey", F.expr("c_mktsegment COLLATE UTF8_LCASE").alias("segment"))
    lower = words.withColumn("segment", F.lower("segment"))
    modes = [verdict(words, lower, CheckSpec(mode, digest=mode == "digest")) for mode in ("rows", "digest")]
    return modes[0].unionByName(modes[1]).select("name", "src_count", "data.reason", "data.src_only_count")


def landing_format_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset landed as Parquet and then, altered, as JSON lines: what is loaded is the latter."""
    orders = relations(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    landing = Landing(spark, _shared_folder(spark))
    landing.write("src", "orders", orders)
    landing.write("src", "orders", altered_orders(orders), "json")
    return landing.load("src", "orders").select("o_orderkey", "o_orderstatus")


def landing_broken_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published version, read while the remains of broken and foreign runs of every kind lie beside it."""
    orders = relations(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    landing = Landing(spark, _shared_folder(spark))
    for rows, form in ((orders.limit(0), "json"), (orders, "parquet"), (altered_orders(orders), "json")):
        landing.publish("src", "orders", rows, form)
    few = orders.where("o_orderkey < 100")
    few.write.parquet(landing.path("src", "orders"))  # a form of its own, complete
    few.write.json(landing.path("src", "orders", ".jsonl"))
    few.write.parquet(f"{landing.path('src', 'orders', '.versions')}/left")  # written, never published
    return landing.load("src", "orders").select("o_orderkey", "o_orderstatus")


def landing_json_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NaN on one side and NULL on the other, landed as JSON lines, are the same value."""
    customer = relations(spark, sf_dir)["customer"].select("c_custkey", "c_acctbal")
    missing = F.col("c_custkey") % 10 == 0
    sides = {
        side: FrameSource({"customer": customer.withColumn("c_acctbal", F.when(missing, F.lit(value).cast("double")).otherwise(F.col("c_acctbal").cast("double")))})
        for side, value in (("src", float("nan")), ("trg", None))
    }
    data_dir = _shared_folder(spark)
    extract(spark, sides, ["customer"], data_dir, fmt="json")
    return run_suite(spark, Landing(spark, data_dir), CheckSuite(lists={"data_list": ["customer"]})).summary


def _document(rows: DataFrame, path: str, wrap: str | None) -> None:
    """Write rows as one JSON document, the exchange format that is one list by definition."""
    listed = F.collect_list(F.struct("*"))
    whole = F.to_json(F.struct(listed.alias(wrap)) if wrap else listed)
    rows.agg(whole.alias("value")).write.text(path)


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of rows and two kinds of wrapped lists, each one JSON document, loaded together."""
    supplier = relations(spark, sf_dir)["supplier"].select("s_suppkey", "s_name")
    landing = Landing(spark, _shared_folder(spark))
    for name, wrap in (("plain", None), ("wrapped", "wrapped"), ("lone", "rows")):
        _document(supplier, landing.path("src", name, ".json"), wrap)
    loaded = landing.load_all("src", ["plain", "wrapped", "lone"])
    parts = [frame.select(F.lit(name).alias("dataset"), "s_suppkey", "s_name") for name, frame in loaded.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def json_document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as one JSON array, written line by line, a part a task, and read back in byte ranges."""
    docs = relations(spark, sf_dir)["documents"].select("doc_id", "source", "text")
    first, last = (docs.agg(end("doc_id")).scalar() for end in (F.min, F.max))
    opening = F.when(F.col("doc_id") == first, '{"about": {"n": [1, {"}": "]"}]}, "documents": [').otherwise(", ")
    closing = F.when(F.col("doc_id") == last, '], "rest": []}').otherwise("")
    row = F.to_json(F.struct("doc_id", "source", "text"))
    lines = docs.select("doc_id", F.concat(opening, row, closing).alias("line"))
    landing = Landing(spark, _shared_folder(spark), {"documents": docs.schema})
    lines.orderBy("doc_id").select("line").write.text(landing.path("src", "documents", ".json.parts"))
    return landing.load("src", "documents").select("doc_id", "source", F.md5(F.encode("text", "UTF-8")).alias("digest"))


def summary_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a suite with ill-typed options, written twice and read back."""
    orders = relations(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = _shared_folder(spark)
    landing = Landing(spark, path)
    landing.write("src", "orders", orders)
    landing.write("trg", "orders", altered_orders(orders).withColumnRenamed("o_orderstatus", "status"))
    suite = CheckSuite(
        lists={"data_list": ["orders"]}, check_list=7, mapping_fields={"orders": {"o_orderstatus": "status", "x": 1}, 3: {}},
        exclude_fields={"orders": ["o_totalprice", 5], "other": "text"}, sample_diff_rows="many", debug="no",
    )
    summary = run_suite(spark, landing, suite).summary
    for _ in range(2):
        write_summary(summary, f"{path}/report", suite.check_list)
    return spark.read.json(f"{path}/report").select("name", "rows_count", "columns", "data", "status", "check_list")


def summary_sink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a suite, the first repeated under its id: the report holds each run once, as it was last."""
    orders = relations(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus")
    results = [verdict(orders, trg, CheckSpec("orders")) for trg in (orders, altered_orders(relations(spark, sf_dir)["orders"]).select("o_orderkey", "o_orderstatus"))]
    report = f"{_shared_folder(spark)}/report"
    for run_id, result in (("first", results[0]), ("second", results[0]), ("first", results[1])):
        write_summary(summary(result), report, "data_list", run_id)
    return spark.read.json(report).select("run_id", "name", "rows_count", "columns", "data", "status", "check_list")


def qa_view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of every derived dataset, in order, next to their number."""
    lists = column_lists(spark, Catalog(relations(spark, sf_dir)), DATASETS)
    return lists.withColumn("n_columns", F.size(F.split("columns_list", ", ")).cast("long"))


QUERIES = {
    "summary_sink_runs": summary_sink_runs,
    "qa_view_columns": qa_view_columns,
    "recon_column_named_side": recon_column_named_side,
    "recon_digest_collated": recon_digest_collated,
    "landing_format_change": landing_format_change,
    "landing_broken_swap": landing_broken_swap,
    "landing_json_nan": landing_json_nan,
    "json_documents": json_documents,
    "json_document_split": json_document_split,
    "summary_sink": summary_sink,
    "qa_row_counts": qa_row_counts,
    "qa_table_counts": qa_table_counts,
    "qa_column_lists": qa_column_lists,
    "adhoc_query": adhoc_query,
    "materialised_feeds": materialised_feeds,
    "landing_suite": landing_suite,
    "landing_json_log": landing_json_log,
}

_KEPT = "NOT (o_orderstatus = 'F' AND o_totalprice < 20000)"
_CHANGED = "o_totalprice > 450000 AND o_orderstatus <> 'X'"

_TABLE_COUNTS = "\nUNION ALL ".join(
    f"SELECT '{name}' AS view_name, count(*) AS row_count FROM {name}" for name in TABLES
)

ORACLE = {
    "summary_sink_runs": f"""
SELECT run_id, 'orders' AS name, if(lost > 0 AND run_id = 'first', 'FAIL', 'PASS') AS rows_count, 'PASS' AS columns,
       if(lost + changed > 0 AND run_id = 'first', 'FAIL', 'PASS') AS data, if(lost + changed > 0 AND run_id = 'first', 'FAIL', 'PASS') AS status, 'data_list' AS check_list
FROM (SELECT count(*) FILTER (NOT ({_KEPT})) AS lost, count(*) FILTER ({_KEPT} AND {_CHANGED}) AS changed FROM orders),
     (VALUES ('first'), ('second')) runs(run_id)
""",
    "qa_view_columns": "\nUNION ALL ".join(
        f"SELECT '{name}' AS view_name, string_agg(column_name, ', ') AS columns_list, count(*) AS n_columns FROM (DESCRIBE ({sql}))" for name, sql in DERIVED_SQL.items()
    ),
    "recon_column_named_side": """
SELECT 'src' AS __side, o_orderkey, o_orderstatus AS side FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'Z'
UNION ALL SELECT 'trg', o_orderkey, 'Z' FROM orders WHERE o_orderkey % 100 = 0 AND o_orderstatus <> 'Z'
""",
    "recon_digest_collated": """
SELECT name, count(*) AS src_count, 'Exact match' AS reason, 0 AS src_only_count
FROM customer, (VALUES ('rows'), ('digest')) v(name) GROUP BY name
""",
    "landing_format_change": f"""
SELECT o_orderkey, if({_CHANGED}, 'X', o_orderstatus) AS o_orderstatus FROM orders WHERE {_KEPT}
""",
    "landing_broken_swap": f"""
SELECT o_orderkey, if({_CHANGED}, 'X', o_orderstatus) AS o_orderstatus FROM orders WHERE {_KEPT}
""",
    "landing_json_nan": "SELECT * FROM (VALUES ('customer', 'PASS', 'PASS', 'PASS', 'PASS')) v(name, rows_count, columns, data, status)",
    "json_documents": """
SELECT dataset, s_suppkey, s_name FROM supplier, (VALUES ('plain'), ('wrapped'), ('lone')) v(dataset)
""",
    "json_document_split": "SELECT doc_id, source, md5(text) AS digest FROM documents",
    "summary_sink": f"""
SELECT 'orders' AS name, if(lost = 0, 'PASS', 'FAIL') AS rows_count, 'PASS' AS columns,
       if(lost + changed = 0, 'PASS', 'FAIL') AS data, if(lost + changed = 0, 'PASS', 'FAIL') AS status, 'data_list' AS check_list
FROM (SELECT count(*) FILTER (NOT ({_KEPT})) AS lost, count(*) FILTER ({_KEPT} AND {_CHANGED}) AS changed FROM orders),
     (VALUES (1), (2)) twice(n)
""",
    "qa_row_counts": "\nUNION ALL ".join(
        f"SELECT '{name}' AS view_name, count(*) AS row_count FROM ({sql})" for name, sql in DERIVED_SQL.items()
    ),
    "qa_table_counts": _TABLE_COUNTS,
    "qa_column_lists": f"""
SELECT c.table_name AS view_name, string_agg(c.column_name, ', ' ORDER BY c.ordinal_position) AS columns_list,
       any_value(r.row_count) AS row_count
FROM information_schema.columns c JOIN ({_TABLE_COUNTS}) r ON r.view_name = c.table_name GROUP BY 1
""",
    "adhoc_query": f"""
SELECT s.content_collection_id, count(*) AS n_codes, count(DISTINCT f.feed_code) AS n_feeds
FROM ({DERIVED_SQL["nsa_v_mapped_source_code"]}) s
JOIN ({DERIVED_SQL["nsa_v_feed_source_code"]}) f USING (source_code, consolidation_id)
WHERE consolidation_id = 654 AND s.status = 'ACTIVE' GROUP BY 1
""",
    "materialised_feeds": f"""
SELECT feed_code, snapshot_id, feed_instance_count, 655 AS consolidation_id FROM ({DERIVED_SQL["nsa_v_feeds"]})
""",
    "landing_suite": f"""
SELECT 'orders' AS name, if(lost = 0, 'PASS', 'FAIL') AS rows_count, 'PASS' AS columns,
       if(lost + changed = 0, 'PASS', 'FAIL') AS data, if(lost + changed = 0, 'PASS', 'FAIL') AS status
FROM (SELECT count(*) FILTER (NOT ({_KEPT})) AS lost, count(*) FILTER ({_KEPT} AND {_CHANGED}) AS changed FROM orders)
UNION ALL VALUES ('customer', 'PASS', 'PASS', 'PASS', 'PASS'), ('part', 'PASS', 'FAIL', 'FAIL', 'FAIL'),
                 ('absent', '-ER-', '-ER-', '-ER-', '-ER-')
""",
    "landing_json_log": f"""
SELECT 'src' AS side, 'orders' AS dataset, count(*) AS rows, false AS failed FROM orders
UNION ALL SELECT 'trg', 'orders', count(*), false FROM orders WHERE {_KEPT}
UNION ALL VALUES ('src', 'absent', NULL, true), ('trg', 'absent', NULL, true)
""",
}
