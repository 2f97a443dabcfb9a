"""Queries of the reconciliation: verdicts, differences, samples, reports.

The target copies are made from the source table by content, so the work grows
with the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.canonical import canonical_text
from ledgermatch.plans import Catalog
from ledgermatch.recon import report
from ledgermatch.recon.diff import compare_columns, except_rows, prepare, sample_rows, subtract
from ledgermatch.recon.spec import CheckSpec
from ledgermatch.recon.verdict import error_verdict, verdict
from ledgermatch.workload.registry import Registry, Tables

registry = Registry()
query = registry.add


def altered_orders(orders: DataFrame) -> DataFrame:
    """A faulty copy: cheap finished orders are lost, expensive ones have another status."""
    return orders.where(~((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 20000))).withColumn(
        "o_orderstatus", F.when(F.col("o_totalprice") > 450000, "X").otherwise(F.col("o_orderstatus"))
    )


_ALTERED = """
SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice > 450000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 20000)
"""
_SRC_ONLY = f"(SELECT * FROM orders EXCEPT ({_ALTERED}))"
_TRG_ONLY = f"(({_ALTERED}) EXCEPT SELECT * FROM orders)"


def flat(results: DataFrame) -> DataFrame:
    """Verdicts without nested columns."""
    return results.select(
        "name", "src_count", "trg_count", "row_count_passed",
        F.col("columns.passed").alias("columns_passed"),
        F.concat_ws(",", "columns.missing_in_trg").alias("missing_in_trg"),
        F.concat_ws(",", "columns.missing_in_src").alias("missing_in_src"),
        F.col("columns.same_order").alias("same_order"),
        F.col("data.passed").alias("data_passed"),
        F.col("data.reason").alias("reason"),
        F.col("data.src_only_count").alias("src_only"),
        F.col("data.trg_only_count").alias("trg_only"),
        "error_message",
    )


def _flat_sql(
    name: str, src: str, trg: str, src_only: str, trg_only: str, columns: str = "true",
    in_trg: str = "''", in_src: str = "''", order: str = "true", passed: str | None = None,
    reason: str | None = None, error: str = "CAST(NULL AS VARCHAR)",
) -> str:
    """The flat verdict as SQL, from expressions for its counts."""
    passed = passed or "src_only = 0 AND trg_only = 0"
    reason = reason or (
        "CASE WHEN src_only = 0 AND trg_only = 0 THEN 'Exact match' ELSE 'Data mismatch-EXCEPT semantics' END"
    )
    return f"""
SELECT '{name}' AS name, src_count, trg_count, src_count = trg_count AS row_count_passed, {columns} AS columns_passed,
       {in_trg} AS missing_in_trg, {in_src} AS missing_in_src, {order} AS same_order, {passed} AS data_passed,
       {reason} AS reason, src_only, trg_only, {error} AS error_message
FROM (SELECT ({src}) AS src_count, ({trg}) AS trg_count, ({src_only}) AS src_only, ({trg_only}) AS trg_only)
"""


_NO_COUNT = "CAST(NULL AS BIGINT)"
_COUNT_ORDERS = "SELECT count(*) FROM orders"
_ORDERS_VERDICT = _flat_sql(
    "orders", _COUNT_ORDERS, f"SELECT count(*) FROM ({_ALTERED})",
    f"SELECT count(*) FROM {_SRC_ONLY}", f"SELECT count(*) FROM {_TRG_ONLY}",
)


@query(_ORDERS_VERDICT)
def recon_summary_orders(t: Tables) -> DataFrame:
    return flat(verdict(t["orders"], altered_orders(t["orders"]), CheckSpec("orders")))


@query(_ORDERS_VERDICT)
def recon_summary_digest(t: Tables) -> DataFrame:
    """The same verdict from digests of the rows."""
    return flat(verdict(t["orders"], altered_orders(t["orders"]), CheckSpec("orders", digest=True)))


@query(f"SELECT * FROM {_SRC_ONLY}")
def recon_src_only(t: Tables) -> DataFrame:
    return subtract(t["orders"], altered_orders(t["orders"]))


@query(f"SELECT * FROM {_TRG_ONLY}")
def recon_trg_only(t: Tables) -> DataFrame:
    return subtract(altered_orders(t["orders"]), t["orders"])


@query(f"SELECT 'src' AS side, * FROM {_SRC_ONLY} UNION ALL SELECT 'trg', * FROM {_TRG_ONLY}")
def recon_both_sides(t: Tables) -> DataFrame:
    """Both EXCEPT results from one shuffle."""
    return except_rows(t["orders"], altered_orders(t["orders"]))


def _sample_sql(side: str, rows: str) -> str:
    text = (
        "CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, "
        "CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, "
        "o_orderpriority"
    )
    members = ", ".join(
        f"'{c}', {c}"
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    )
    return (
        f"SELECT '{side}' AS side, row_number() OVER (ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
        f"o_orderdate, o_orderpriority) AS rank, CAST(json_object({members}) AS VARCHAR) AS row_json "
        f"FROM (SELECT {text} FROM {rows}) QUALIFY rank <= 5"
    )


@query(f"{_sample_sql('src', _SRC_ONLY)} UNION ALL {_sample_sql('trg', _TRG_ONLY)}")
def recon_sample_topk(t: Tables) -> DataFrame:
    """The first differing rows per side, in text order."""
    return sample_rows(t["orders"], altered_orders(t["orders"]), 5)


@query("""
WITH s AS (SELECT l_orderkey, l_suppkey, l_returnflag FROM lineitem),
     t AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_quantity = 50 THEN 'R' ELSE l_returnflag END AS l_returnflag FROM lineitem)
SELECT 'src' AS side, * FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM t)
UNION ALL SELECT 'trg', * FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM s)
""")
def recon_bag(t: Tables) -> DataFrame:
    """Surplus copies count too (EXCEPT ALL)."""
    src = t["lineitem"].select("l_orderkey", "l_suppkey", "l_returnflag")
    trg = t["lineitem"].select(
        "l_orderkey", "l_suppkey",
        F.when(F.col("l_quantity") == 50, "R").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
    )
    return except_rows(src, trg, bag=True)


_CUSTOMER_COUNT = "SELECT count(*) FROM customer"


@query(
    _flat_sql("customer", _CUSTOMER_COUNT, _CUSTOMER_COUNT, "SELECT 0::BIGINT", "SELECT 0::BIGINT")
)
def recon_mapping_exclude(t: Tables) -> DataFrame:
    """Renamed columns match after mapping; a column known to differ is left out."""
    src = t["customer"].withColumnsRenamed({"c_name": "NAME"})
    trg = t["customer"].withColumnsRenamed({"c_name": "name"}).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    spec = CheckSpec("customer", mapping={"NAME": "name"}, exclude=("c_acctbal", "not_there"))
    return flat(verdict(src, trg, spec))


@query(
    _flat_sql(
        "customer", _CUSTOMER_COUNT, _CUSTOMER_COUNT, f"SELECT {_NO_COUNT}", f"SELECT {_NO_COUNT}",
        columns="false", in_trg="'c_acctbal,c_name'", in_src="'label,name'", order="false",
        passed="false", reason="'Skipped: column mismatch'",
    )
)
def recon_columns(t: Tables) -> DataFrame:
    """Different column names end the check before the data is read."""
    trg = t["customer"].withColumnRenamed("c_name", "name").withColumn("label", F.lit("x")).drop("c_acctbal")
    return flat(verdict(t["customer"], trg, CheckSpec("customer")))


@query(_flat_sql("supplier", "SELECT count(*) FROM supplier", "SELECT count(*) FROM supplier",
                 "SELECT 0::BIGINT", "SELECT 0::BIGINT", order="false"))
def recon_column_order(t: Tables) -> DataFrame:
    """Another column order is reported but passes."""
    reversed_columns = t["supplier"].select(*reversed(t["supplier"].columns))
    assert not compare_columns(t["supplier"], reversed_columns).same_order
    return flat(verdict(t["supplier"], reversed_columns, CheckSpec("supplier")))


@query(
    _flat_sql(
        "orders", _COUNT_ORDERS, "SELECT count(*) FROM orders WHERE o_totalprice < 0",
        f"SELECT {_NO_COUNT}", f"SELECT {_NO_COUNT}", columns="false", order="false", passed="false",
        reason="'Skipping due to one dataset empty'",
    )
)
def recon_empty_one(t: Tables) -> DataFrame:
    return flat(verdict(t["orders"], t["orders"].where("o_totalprice < 0"), CheckSpec("orders")))


@query(
    _flat_sql(
        "orders", "SELECT count(*) FROM orders WHERE o_totalprice < 0",
        "SELECT count(*) FROM orders WHERE o_custkey < 0",
        f"SELECT {_NO_COUNT}", f"SELECT {_NO_COUNT}", columns="false", passed="false",
        reason="'Skipping due to both datasets empty'",
    )
)
def recon_empty_both(t: Tables) -> DataFrame:
    o = t["orders"]
    return flat(verdict(o.where("o_totalprice < 0"), o.where("o_custkey < 0"), CheckSpec("orders")))


@query("""
SELECT 'part' AS name, (SELECT count(*) FROM part) AS src_count, (SELECT count(*) FROM part) AS trg_count,
       (SELECT count(*) FROM part WHERE p_type = 'SMALL') AS src_only,
       (SELECT count(*) FROM part WHERE p_type = 'SMALL') AS trg_only
""")
def recon_null_vs_empty(t: Tables) -> DataFrame:
    """NULL equals NULL but not the empty text."""
    small = F.col("p_type") == "SMALL"
    src = t["part"].withColumn("p_type", F.when(~small, F.col("p_type")))
    trg = t["part"].withColumn("p_type", F.when(small, "").otherwise(F.col("p_type")))
    return flat(verdict(src, trg, CheckSpec("part"))).select("name", "src_count", "trg_count", "src_only", "trg_only")


@query("""
SELECT count(*) AS src_count, count(*) AS trg_count,
       count(*) FILTER (o_totalprice = round(o_totalprice)) AS src_only,
       count(*) FILTER (o_totalprice = round(o_totalprice)) AS trg_only FROM orders
""")
def recon_across_types(t: Tables) -> DataFrame:
    """Numbers and times against text: equal when their text is equal, so '5.0' is not '5'."""
    src = t["orders"].select("o_orderkey", "o_totalprice", "o_orderdate")
    whole = F.col("o_totalprice") == F.round("o_totalprice")
    trg = t["orders"].select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(whole, F.format_string("%.0f", "o_totalprice"))
        .otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("double").cast("string"))
        .alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
    )
    counts = flat(verdict(src, trg, CheckSpec("orders")))
    return counts.select("src_count", "trg_count", "src_only", "trg_only")


@query("""
SELECT event_id, '{"ids": [' || event_id || ', ' || user_id || '], "props": {"k": ' || (props ->> '$.k')
       || '}, "type": "' || event_type || '"}' AS canonical FROM events
""")
def json_canonical(t: Tables) -> DataFrame:
    """Nested values as JSON text with sorted keys."""
    nested = t["events"].select(
        "event_id",
        F.struct(
            F.col("event_type").alias("type"),
            F.from_json("props", "struct<k: bigint>").alias("props"),
            F.array("event_id", "user_id").alias("ids"),
        ).alias("doc"),
    )
    return nested.select("event_id", canonical_text(F.col("doc"), nested.schema["doc"].dataType).alias("canonical"))


def _several(t: Tables) -> DataFrame:
    """Verdicts on tables with different faults, and one whose input is missing."""
    spark = t["orders"].sparkSession
    orders, part = t["orders"], t["part"]
    verdicts = [
        verdict(orders, altered_orders(orders), CheckSpec("orders")),
        verdict(t["customer"], t["customer"], CheckSpec("customer")),
        verdict(part, part.drop("p_size"), CheckSpec("part")),
        verdict(t["lineitem"].where("l_tax < 0"), t["lineitem"].where("l_discount < 0"), CheckSpec("lineitem")),
        verdict(t["events"], t["events"].where("value < 0"), CheckSpec("events")),
        error_verdict(spark, "absent", "trg file does not exist"),
    ]
    return reduce(DataFrame.unionByName, verdicts)


_SEVERAL = f"""
SELECT 'orders' AS name, if(a = b, 'PASS', 'FAIL') AS rows_count, 'PASS' AS columns,
       if(d = 0, 'PASS', 'FAIL') AS data, if(a = b AND d = 0, 'PASS', 'FAIL') AS status
FROM (SELECT ({_COUNT_ORDERS}) AS a, (SELECT count(*) FROM ({_ALTERED})) AS b,
             (SELECT count(*) FROM {_SRC_ONLY}) + (SELECT count(*) FROM {_TRG_ONLY}) AS d)
UNION ALL SELECT 'customer', 'PASS', 'PASS', 'PASS', 'PASS'
UNION ALL SELECT 'part', 'PASS', 'FAIL', 'FAIL', 'FAIL'
UNION ALL SELECT 'lineitem', 'NULL', 'NULL', 'NULL', '-ER-' WHERE NOT EXISTS (FROM lineitem WHERE l_tax < 0 OR l_discount < 0)
UNION ALL SELECT 'events', 'FAIL', 'FAIL', 'FAIL', 'FAIL' WHERE NOT EXISTS (FROM events WHERE value < 0)
UNION ALL SELECT 'absent', '-ER-', '-ER-', '-ER-', '-ER-'
"""


@query(_SEVERAL)
def recon_summary(t: Tables) -> DataFrame:
    return report.summary(_several(t))


@query(f"""
SELECT count(*) FILTER (status = 'PASS') AS total_passed, count(*) FILTER (status = 'FAIL') AS total_failed,
       count(*) FILTER (status = '-ER-') AS total_errors FROM ({_SEVERAL})
""")
def recon_status_totals(t: Tables) -> DataFrame:
    return report.totals(report.summary(_several(t)))


@query(f"""
WITH n AS (SELECT ({_COUNT_ORDERS}) AS o, (SELECT count(*) FROM ({_ALTERED})) AS a,
                  (SELECT count(*) FROM {_SRC_ONLY}) AS so, (SELECT count(*) FROM {_TRG_ONLY}) AS tr,
                  ({_CUSTOMER_COUNT}) AS c, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM events) AS e)
SELECT name, "check", outcome, detail FROM n, LATERAL (VALUES
  ('orders', 'row_count_check', if(o = a, 'PASS', 'FAIL'), 'src=' || o || ', trg=' || a),
  ('orders', 'column_name_consistency', 'PASS', 'same_order=True'),
  ('orders', 'full_data_verification', if(so + tr = 0, 'PASS', 'FAIL'), if(so + tr = 0, 'Exact match',
      'Data mismatch-EXCEPT semantics; src_only_rows: ' || so || '; trg_only_rows: ' || tr)),
  ('customer', 'row_count_check', 'PASS', 'src=' || c || ', trg=' || c),
  ('customer', 'column_name_consistency', 'PASS', 'same_order=True'),
  ('customer', 'full_data_verification', 'PASS', 'Exact match'),
  ('part', 'row_count_check', 'PASS', 'src=' || p || ', trg=' || p),
  ('part', 'column_name_consistency', 'FAIL', 'same_order=False; missing_in_trg: [p_size]; missing_in_src: []'),
  ('part', 'full_data_verification', 'FAIL', 'Skipped: column mismatch'),
  ('lineitem', 'error_message', '-ER-', 'there is no data for comparison'),
  ('lineitem', 'row_count_check', 'NULL', 'src=0, trg=0'),
  ('lineitem', 'column_name_consistency', 'NULL', NULL),
  ('lineitem', 'full_data_verification', 'NULL', NULL),
  ('events', 'row_count_check', 'FAIL', 'src=' || e || ', trg=0'),
  ('events', 'column_name_consistency', 'FAIL', 'Skipping'),
  ('events', 'full_data_verification', 'FAIL', 'Skipping'),
  ('absent', 'error_message', '-ER-', 'trg file does not exist'),
  ('absent', 'row_count_check', '-ER-', NULL),
  ('absent', 'column_name_consistency', '-ER-', NULL),
  ('absent', 'full_data_verification', '-ER-', NULL)) d(name, "check", outcome, detail)
""")
def recon_details(t: Tables) -> DataFrame:
    return report.details(_several(t))


@query("""
WITH d AS (SELECT feed_code, consolidation_id, string_agg(product_code, ', ' ORDER BY product_code) AS pc
           FROM (SELECT DISTINCT feed_code, consolidation_id, product_code FROM t_feed_product_code) GROUP BY ALL)
SELECT (SELECT count(*) FROM t_feeds) AS src_count, (SELECT count(*) FROM t_feeds) AS trg_count,
       count(*) AS src_only, count(*) AS trg_only
FROM d JOIN t_feeds USING (feed_code, consolidation_id) WHERE length(pc) > 1024
""")
def recon_truncated_lists(t: Tables) -> DataFrame:
    """A source whose database cuts long lists, against the whole lists."""
    whole = Catalog(t)["tmp_nsa_v_feed_all_grouped"]
    cut = whole.withColumn("pc", F.left("pc", F.lit(1024)))
    counts = flat(verdict(cut, whole, CheckSpec("feeds")))
    return counts.select("src_count", "trg_count", "src_only", "trg_only")


@query("SELECT count(*) AS src_count, count(*) AS trg_count, 'PASS' AS status FROM t_feeds")
def recon_excluded_lists(t: Tables) -> DataFrame:
    """The same with the cut column left out: the copies agree."""
    whole = Catalog(t)["tmp_nsa_v_feed_all_grouped"]
    cut = whole.withColumn("pc", F.left("pc", F.lit(1024)))
    result = verdict(cut, whole, CheckSpec("feeds", exclude=("pc",)))
    return report.summary(result, "src_count", "trg_count").select("src_count", "trg_count", "status")


@query(f"""
SELECT (SELECT count(*) FROM {_SRC_ONLY}) AS src_only, (SELECT count(*) FROM {_TRG_ONLY}) AS trg_only
""")
def recon_prepared(t: Tables) -> DataFrame:
    """Differences after mapping, counted from the full diff."""
    spec = CheckSpec("orders", mapping={"STATUS": "status", "o_orderstatus": "status"})
    src, trg = prepare(t["orders"], spec), prepare(altered_orders(t["orders"]), spec)
    return except_rows(src, trg).agg(
        F.count_if(F.col("side") == "src").alias("src_only"), F.count_if(F.col("side") == "trg").alias("trg_only")
    )
