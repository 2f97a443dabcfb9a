"""Queries of the relational operators, aggregates and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.functions.codes import (
    leading_digits,
    remove_all,
    strip_prefix,
    strip_suffix,
    to_bigint,
    try_to_bigint,
)
from ledgermatch.functions.text import (
    blank_if_null,
    collated,
    concat_blank,
    concat_strict,
    distinct_text_agg,
    joined_or_null,
    length_without_trailing_blanks,
    null_text,
    string_agg,
)
from ledgermatch.operators.combine import combinations
from ledgermatch.operators.lookup import (
    contains_words,
    exists,
    left_with,
    left_with_existing,
    not_exists,
    not_in,
    unmatched_or_null,
)
from ledgermatch.operators.rollup import (
    Rollup,
    attach,
    count_distinct_per,
    labels,
    last_row,
    list_all,
    list_limited,
    roll_up,
)
from ledgermatch.operators.snapshot import at_latest, greatest, in_latest
from ledgermatch.sources.jdbc import PredicateSplit, depth_bounds
from ledgermatch.workload.registry import Registry, Tables

registry = Registry()
query = registry.add


# --- aggregates -------------------------------------------------------------


@query("""
SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1
""")
def listagg_distinct(t: Tables) -> DataFrame:
    """Sorted distinct texts per key."""
    return t["lineitem"].groupBy("l_orderkey").agg(
        distinct_text_agg(F.col("l_returnflag"), ", ").alias("flags")
    )


@query("""
SELECT l_orderkey, string_agg(l_returnflag, '; ' ORDER BY l_returnflag) AS flags, count(*) AS n
FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_returnflag FROM lineitem) GROUP BY 1
""")
def listagg_pair_distinct(t: Tables) -> DataFrame:
    """Distinct per (id, label): equal labels of different ids repeat."""
    return roll_up(
        [labels(t["lineitem"], "F", ["l_orderkey"], "l_returnflag", identity="l_suppkey")],
        ["l_orderkey"],
        [Rollup("F", "flags", "n", "; ")],
    )


@query("""
SELECT o_custkey, string_agg(coalesce(nullif(o_orderstatus, 'P'), ''), ',' ORDER BY coalesce(nullif(o_orderstatus, 'P'), '')) AS s
FROM orders GROUP BY 1
""")
def listagg_null_blank(t: Tables) -> DataFrame:
    """Repeats kept, NULL written as an empty entry."""
    status = blank_if_null(F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return list_all(t["orders"].select("o_custkey", status.alias("status")), ["o_custkey"], "status", ",", "s")


@query("""
SELECT o_custkey, string_agg(nullif(o_orderstatus, 'P'), '|' ORDER BY o_orderstatus) AS s FROM orders GROUP BY 1
""")
def listagg_skips_null(t: Tables) -> DataFrame:
    """NULL entries are skipped; only NULLs give NULL."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return list_all(t["orders"].select("o_custkey", status.alias("status")), ["o_custkey"], "status", "|", "s")


@query("""
SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ', ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS s
FROM lineitem GROUP BY 1
""")
def listagg_order_by_other(t: Tables) -> DataFrame:
    """Ordered by a column other than the listed one."""
    return t["lineitem"].select(
        "l_orderkey", "l_linenumber", concat_strict(F.col("l_returnflag"), F.col("l_linestatus")).alias("flag")
    ).groupBy("l_orderkey").agg(string_agg("flag", ", ", order_by=["l_linenumber", "flag"]).alias("s"))


@query("""
SELECT l_orderkey, left(string_agg(l_returnflag, ',' ORDER BY l_returnflag), 7) AS s FROM lineitem GROUP BY 1
""")
def listagg_length_limited(t: Tables) -> DataFrame:
    """The list as a database with a length limit would return it."""
    return list_limited(t["lineitem"], ["l_orderkey"], "l_returnflag", ",", "s", 7)


@query("""
SELECT lang, left(string_agg(text, '; ' ORDER BY text), 1024) AS texts FROM documents GROUP BY 1
""")
def listagg_limited_hot_key(t: Tables) -> DataFrame:
    """A list over whole texts for a few keys that hold all rows; only what can show is shuffled by key."""
    return list_limited(t["documents"], ["lang"], "text", "; ", "texts", 1024)


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def ranges_of_equal_depth(t: Tables) -> DataFrame:
    """A table read range by range, as a database scan would be with the bounds of an equi-depth histogram."""
    events = t["events"]
    split = PredicateSplit.by_bounds("user_id", depth_bounds(events, "user_id", 16), within="event_id")
    parts = [events.where(p) for p in split.predicates]
    whole = reduce(DataFrame.unionAll, parts)
    return whole.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))


@query("""
SELECT o_orderpriority, count(*) AS n, count(nullif(o_orderstatus, 'P')) AS n_status,
       count(DISTINCT o_custkey) AS n_customers, max(o_orderdate) AS last_date, max(o_totalprice) AS top_price
FROM orders GROUP BY 1
""")
def count_and_max(t: Tables) -> DataFrame:
    """Counts of rows, of non-NULL and of distinct values, and maxima."""
    return t["orders"].groupBy("o_orderpriority").agg(
        F.count("*").alias("n"),
        F.count(F.nullif(F.col("o_orderstatus"), F.lit("P"))).alias("n_status"),
        F.count_distinct("o_custkey").alias("n_customers"),
        F.max("o_orderdate").alias("last_date"),
        F.max("o_totalprice").alias("top_price"),
    )


@query("""
SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def group_by_hidden_key(t: Tables) -> DataFrame:
    """A grouping column that is not in the result."""
    return t["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).drop("l_linestatus")


# --- roll-ups ---------------------------------------------------------------


@query("""
WITH x AS (
  SELECT o_custkey,
    string_agg(label, ', ' ORDER BY label) FILTER (kind = 'S') AS statuses, count(*) FILTER (kind = 'S') AS n_statuses,
    string_agg(label, ', ' ORDER BY label) FILTER (kind = 'P') AS priorities, count(*) FILTER (kind = 'P') AS n_priorities
  FROM (SELECT o_custkey, 'S' AS kind, o_orderstatus AS label FROM orders
        UNION SELECT o_custkey, 'P', o_orderpriority FROM orders) GROUP BY 1)
SELECT c.c_custkey, c.c_name, x.statuses, coalesce(x.n_statuses, 0) AS n_statuses, x.priorities,
       coalesce(x.n_priorities, 0) AS n_priorities
FROM customer c LEFT JOIN x ON x.o_custkey = c.c_custkey
""")
def rollup_outer_apply(t: Tables) -> DataFrame:
    """Two distinct lists with counts per outer row, in one pass."""
    rolled = roll_up(
        [
            labels(t["orders"], "S", ["o_custkey"], "o_orderstatus"),
            labels(t["orders"], "P", ["o_custkey"], "o_orderpriority"),
        ],
        ["o_custkey"],
        [Rollup("S", "statuses", "n_statuses"), Rollup("P", "priorities", "n_priorities")],
    )
    base = t["customer"].select("c_custkey", "c_name")
    return attach(base, rolled.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], ["n_statuses", "n_priorities"])


@query("""
SELECT c_custkey, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) AS n
FROM customer
""")
def rollup_zero_count(t: Tables) -> DataFrame:
    """A distinct count per outer row, 0 where nothing matches."""
    counts = count_distinct_per(
        t["orders"].where("o_totalprice > 450000").withColumnRenamed("o_custkey", "c_custkey"),
        ["c_custkey"], "o_orderpriority", "n",
    )
    return attach(t["customer"].select("c_custkey"), counts, ["c_custkey"], ["n"])


@query("""
SELECT c.c_name, x.statuses, coalesce(x.n, 0) AS n FROM customer c LEFT JOIN (
  SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '; ' ORDER BY o_orderstatus) AS statuses,
         count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1) x
ON x.o_custkey = CAST(replace(c.c_name, 'Customer#', '') AS BIGINT)
""")
def rollup_computed_key(t: Tables) -> DataFrame:
    """The outer row's key is computed from a text."""
    rolled = roll_up(
        [labels(t["orders"], "S", ["o_custkey"], "o_orderstatus")],
        ["o_custkey"],
        [Rollup("S", "statuses", "n", "; ")],
    )
    base = t["customer"].select(
        "c_name", to_bigint(remove_all(F.col("c_name"), "Customer#")).alias("o_custkey")
    )
    return attach(base, rolled, ["o_custkey"], ["n"]).drop("o_custkey")


@query("""
SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id
FROM events GROUP BY 1
""")
def argmax_row(t: Tables) -> DataFrame:
    """The whole last row per key."""
    return last_row(t["events"], ["user_id"], "event_id", ["event_type", "value", "event_id"])


# --- codes and text ---------------------------------------------------------


@query("""
SELECT c_custkey, replace(c_name, 'Customer#', '') AS bare, 'Customer#' || c_name AS twice,
       substr('Customer#' || c_name, 10) AS once, c_mktsegment AS untouched FROM customer
""")
def prefix_strip(t: Tables) -> DataFrame:
    """A prefix is removed once and only at the start."""
    twice = concat_strict(F.lit("Customer#"), F.col("c_name"))
    return t["customer"].select(
        "c_custkey",
        strip_prefix(F.col("c_name"), "Customer#").alias("bare"),
        twice.alias("twice"),
        strip_prefix(twice, "Customer#").alias("once"),
        strip_prefix(F.col("c_mktsegment"), "Customer#").alias("untouched"),
    )


@query("SELECT p_partkey, replace(p_name || ' ' || p_name, 'red ', '') AS name FROM part")
def replace_all(t: Tables) -> DataFrame:
    """Every occurrence is removed."""
    doubled = concat_strict(F.col("p_name"), F.lit(" "), F.col("p_name"))
    return t["part"].select("p_partkey", remove_all(doubled, "red ").alias("name"))


_NUMBER_TEXT = """
CASE p_type WHEN 'SMALL' THEN p_size || 'M' WHEN 'LARGE' THEN p_size || 'MM' WHEN 'ECONOMY' THEN 'M'
            WHEN 'PROMO' THEN p_size || '-7' ELSE CAST(p_size AS VARCHAR) END
"""


def _number_text() -> Column:
    """Numbers as they come in code tables: with suffix, doubled suffix, nothing but it, junk."""
    size = F.col("p_size").cast("string")
    return (
        F.when(F.col("p_type") == "SMALL", F.concat(size, F.lit("M")))
        .when(F.col("p_type") == "LARGE", F.concat(size, F.lit("MM")))
        .when(F.col("p_type") == "ECONOMY", F.lit("M"))
        .when(F.col("p_type") == "PROMO", F.concat(size, F.lit("-7")))
        .otherwise(size)
    )


@query(f"SELECT p_partkey, regexp_replace({_NUMBER_TEXT}, 'M$', '') AS value FROM part")
def suffix_strip(t: Tables) -> DataFrame:
    """One trailing M is removed."""
    return t["part"].select("p_partkey", strip_suffix(_number_text()).alias("value"))


@query(f"SELECT p_partkey, regexp_extract({_NUMBER_TEXT}, '^[0-9]*') AS digits FROM part")
def leading_digit_run(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", leading_digits(_number_text()).alias("digits"))


@query(f"""
SELECT p_partkey, CASE WHEN v = '' THEN 0 ELSE TRY_CAST(v AS BIGINT) END AS value,
       CASE WHEN d = '' THEN 0 ELSE TRY_CAST(d AS BIGINT) END AS leading_value
FROM (SELECT p_partkey, regexp_replace({_NUMBER_TEXT}, 'M$', '') AS v, regexp_extract({_NUMBER_TEXT}, '^[0-9]*') AS d FROM part)
""")
def try_cast_bigint(t: Tables) -> DataFrame:
    """Text that is no number gives NULL, blank text gives 0."""
    return t["part"].select(
        "p_partkey",
        try_to_bigint(strip_suffix(_number_text())).alias("value"),
        try_to_bigint(leading_digits(_number_text())).alias("leading_value"),
    )


@query("SELECT s_suppkey, CAST(substr(s_name, 10) AS BIGINT) AS number FROM supplier")
def strict_cast_bigint(t: Tables) -> DataFrame:
    """Text to number, bad text being an error."""
    return t["supplier"].select(
        "s_suppkey", to_bigint(strip_prefix(F.col("s_name"), "Supplier#")).alias("number")
    )


@query("SELECT o_orderstatus, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1 HAVING count(*) > 0")
def cast_count_text(t: Tables) -> DataFrame:
    """A count is compared as a number and shown as text."""
    counts = t["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")).where(F.col("n") > 0)
    return counts.withColumn("n", F.col("n").cast("string"))


@query("""
SELECT p_partkey, concat(p_name, ' (', nullif(p_type, 'SMALL'), ')') AS blank, p_name || nullif(p_type, 'SMALL') AS strict FROM part
""")
def concat_null_blank(t: Tables) -> DataFrame:
    """Concatenation that reads NULL as '' and one that passes NULL on."""
    kind = F.nullif(F.col("p_type"), F.lit("SMALL"))
    return t["part"].select(
        "p_partkey",
        concat_blank(F.col("p_name"), F.lit(" ("), kind, F.lit(")")).alias("blank"),
        concat_strict(F.col("p_name"), kind).alias("strict"),
    )


@query("""
SELECT p_partkey, nullif(concat_ws(' - ', nullif(p_type, 'SMALL'), if(p_type IN ('SMALL', 'LARGE'), NULL, p_brand)), '') AS descr
FROM part
""")
def concat_ws_nullif(t: Tables) -> DataFrame:
    brand = F.when(~F.col("p_type").isin("SMALL", "LARGE"), F.col("p_brand"))
    return t["part"].select(
        "p_partkey", joined_or_null(" - ", F.nullif(F.col("p_type"), F.lit("SMALL")), brand).alias("descr")
    )


@query("""
SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size < 10 THEN 'small' END AS size_class,
       CASE WHEN p_size > 25 THEN 'upper' ELSE 'lower' END AS half, CAST(NULL AS VARCHAR) AS url,
       'ACTIVE' AS status FROM part
""")
def case_no_else(t: Tables) -> DataFrame:
    """CASE with and without ELSE, constants and a typed NULL."""
    size = F.col("p_size")
    return t["part"].select(
        "p_partkey",
        F.when(size > 40, "big").when(size < 10, "small").alias("size_class"),
        F.when(size > 25, "upper").otherwise("lower").alias("half"),
        null_text().alias("url"),
        F.lit("ACTIVE").alias("status"),
    )


@query("""
SELECT c_custkey, CAST(length(c_mktsegment) AS INTEGER) AS trimmed, CAST(length(c_mktsegment) + 2 AS INTEGER) AS counted, left(c_mktsegment, 3) AS head,
       right(c_mktsegment, 3) AS tail, substring(c_mktsegment, 2, 3) AS middle FROM customer
""")
def text_lengths(t: Tables) -> DataFrame:
    """Length with and without trailing blanks, and parts of a text."""
    segment = F.col("c_mktsegment")
    padded = F.concat(segment, F.lit("  "))
    return t["customer"].select(
        "c_custkey",
        length_without_trailing_blanks(padded).alias("trimmed"),
        F.length(padded).alias("counted"),
        F.left(segment, F.lit(3)).alias("head"),
        F.right(segment, F.lit(3)).alias("tail"),
        F.substring(segment, 2, 3).alias("middle"),
    )


@query("""
SELECT lower(k) AS segment, count(*) AS n FROM (
  SELECT if(c_acctbal < 0, lower(c_mktsegment), c_mktsegment) AS k FROM customer) GROUP BY 1
""")
def collation_group(t: Tables) -> DataFrame:
    """Grouping under a collation that ignores case."""
    mixed = t["customer"].select(
        F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("segment")
    )
    grouped = collated(mixed, "UTF8_LCASE").groupBy("segment").agg(F.count("*").alias("n"))
    return grouped.select(F.lower(F.collate("segment", "UTF8_BINARY")).alias("segment"), "n")


# --- projections and filters ------------------------------------------------


@query("""
SELECT s_name AS "Supplier Name", s_nationkey AS "Nation", 'Supplier Check' AS "Check Type" FROM supplier
""")
def alias_with_blanks(t: Tables) -> DataFrame:
    return t["supplier"].select(
        F.col("s_name").alias("Supplier Name"), F.col("s_nationkey").alias("Nation"), F.lit("Supplier Check").alias("Check Type")
    )


@query("SELECT *, replace(s_name, 'Supplier#', '') AS number, s_acctbal < 0 AS in_debt FROM supplier")
def star_and_computed(t: Tables) -> DataFrame:
    return t["supplier"].withColumns(
        {"number": strip_prefix(F.col("s_name"), "Supplier#"), "in_debt": F.col("s_acctbal") < 0}
    )


@query("""
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
WHERE (o_orderstatus = 'O' OR o_totalprice > 300000) AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED')
  AND o_orderpriority LIKE '1%' AND o_orderstatus <> 'F' AND o_orderdate IS NOT NULL
""")
def filters(t: Tables) -> DataFrame:
    return (
        t["orders"]
        .where(((F.col("o_orderstatus") == "O") | (F.col("o_totalprice") > 300000)) & (F.col("o_orderstatus") != "F"))
        .where(~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"))
        .where(F.col("o_orderpriority").startswith("1") & F.col("o_orderdate").isNotNull())
        .select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    )


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t: Tables) -> DataFrame:
    return t["orders"].select("o_custkey", "o_orderstatus", "o_orderpriority").distinct()


# --- joins ------------------------------------------------------------------


@query("""
SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def join_inner(t: Tables) -> DataFrame:
    c, o, n = t["customer"], t["orders"], t["nation"]
    return (
        o.join(c, o["o_custkey"] == c["c_custkey"])
        .join(n, c["c_nationkey"] == n["n_nationkey"])
        .select("o_orderkey", "c_name", "n_name")
    )


@query("""
SELECT c.code, v.industry, c.feed_code, c.consolidation_id FROM t_feed_codes c
JOIN (SELECT DISTINCT code, industry, consolidation_id FROM nsa_v_code_industry) v
ON v.code = c.code AND v.consolidation_id = c.consolidation_id
""")
def join_inner_composite(t: Tables) -> DataFrame:
    """Join on a code and its consolidation; the many-sided input is made distinct first and hashed, so the other isn't sorted."""
    named = t["nsa_v_code_industry"].select("code", "industry", "consolidation_id").distinct()
    return t["t_feed_codes"].join(named.hint("shuffle_hash"), ["code", "consolidation_id"]).select(
        "code", "industry", "feed_code", "consolidation_id"
    )


@query("""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 400000
""")
def join_left_on_literal(t: Tables) -> DataFrame:
    """A literal condition in ON keeps customers without such an order."""
    rare = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 400000)
    return left_with(
        t["customer"].select("c_custkey"), t["orders"], [("c_custkey", "o_custkey")], rare
    ).select("c_custkey", "o_orderkey")


@query("""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)
) x ON o_custkey = c_custkey
""")
def join_left_on_exists(t: Tables) -> DataFrame:
    """An EXISTS in ON restricts the right side only."""
    large = t["lineitem"].where((F.col("l_quantity") == 50) & (F.col("l_discount") > 0.09))
    return left_with_existing(
        t["customer"].select("c_custkey"), t["orders"], [("c_custkey", "o_custkey")],
        large, [("o_orderkey", "l_orderkey")],
    ).select("c_custkey", "o_orderkey")


@query("""
SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (
  SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)) x ON o_custkey = c_custkey
""")
def join_left_on_scalar(t: Tables) -> DataFrame:
    """A scalar subquery in ON restricts the right side only."""
    newest = F.col("o_orderdate") == greatest(t["orders"], "o_orderdate")
    return left_with(
        t["customer"].select("c_custkey"), t["orders"], [("c_custkey", "o_custkey")], newest
    ).select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_left_null(t: Tables) -> DataFrame:
    """LEFT JOIN ... IS NULL as an anti join."""
    return not_exists(
        t["customer"], t["orders"].where("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")]
    ).select("c_custkey", "c_name")


@query("""
SELECT l_orderkey, l_suppkey FROM lineitem LEFT JOIN (
  SELECT s_suppkey, bool_or(s_acctbal < 0) AS unnamed FROM supplier WHERE s_acctbal < 5000 GROUP BY 1) ON s_suppkey = l_suppkey
WHERE s_suppkey IS NULL OR unnamed
""")
def anti_left_null_tested(t: Tables) -> DataFrame:
    """LEFT JOIN ... IS NULL on a column that can itself be NULL."""
    named = t["supplier"].where("s_acctbal < 5000").select(
        "s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_name")).alias("s_name")
    )
    lines = t["lineitem"].select("l_orderkey", "l_suppkey")
    return unmatched_or_null(lines, "l_suppkey", named, "s_suppkey", "s_name")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_totalprice > 300000 AND 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') = c_name)
""")
def anti_not_exists(t: Tables) -> DataFrame:
    """NOT EXISTS on a computed key."""
    large = t["orders"].where("o_totalprice > 300000").select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("name")
    )
    return not_exists(t["customer"], large, [("c_name", "name")]).select("c_custkey")


@query("""
SELECT 'no null in list' AS case_name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT 'null in list', count(*) FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders)
UNION ALL SELECT 'empty list', count(*) FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)
UNION ALL SELECT 'null key', count(*) FROM customer WHERE nullif(c_nationkey, 3) NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)
""")
def anti_not_in_nullaware(t: Tables) -> DataFrame:
    """NOT IN with its NULL rules: list with and without NULL, empty list, NULL key."""
    c, o, s = t["customer"], t["orders"], t["supplier"]
    keyed = c.select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation"))
    cases = {
        "no null in list": not_in(c, "c_custkey", o.where("o_totalprice > 300000"), "o_custkey"),
        "null in list": not_in(
            c, "c_custkey", o.select(F.nullif(F.col("o_custkey"), F.lit(1)).alias("k")), "k"
        ),
        "empty list": not_in(keyed, "nation", o.where("o_totalprice < 0"), "o_custkey"),
        "null key": not_in(keyed, "nation", s.where("s_acctbal < 0"), "s_nationkey"),
    }
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("case_name"), "n") for k, df in cases.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_exists(t: Tables) -> DataFrame:
    return exists(
        t["customer"], t["orders"].where("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")]
    ).select("c_custkey", "c_name")


@query("""
SELECT feed_code, feed_index, snapshot_id FROM ucdp_v_feed WHERE snapshot_id IN (
  SELECT snapshot_id FROM t_dm_in_data_snapshot WHERE supplier_id = 'S:UCDP' AND latest = 'Y' AND data_type = 'ALL')
""")
def semi_in_latest(t: Tables) -> DataFrame:
    """Rows of the snapshots a registry calls latest."""
    return in_latest(
        t["ucdp_v_feed"].select("feed_code", "feed_index", "snapshot_id"), t["t_dm_in_data_snapshot"], "S:UCDP", "ALL"
    )


@query("""
SELECT product_code, snapshot_id FROM rds_product_code WHERE snapshot_id = (
  SELECT snapshot_id FROM t_dm_in_data_snapshot WHERE supplier_id = 'S:RDS' AND data_type = 'RDS_PRODUCTS' AND latest = 'Y')
""")
def scalar_latest(t: Tables) -> DataFrame:
    """Rows of the one latest snapshot, by scalar subquery."""
    return at_latest(
        t["rds_product_code"], t["t_dm_in_data_snapshot"], "S:RDS", "RDS_PRODUCTS"
    ).select("product_code", "snapshot_id")


@query("SELECT * FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def scalar_max_filter(t: Tables) -> DataFrame:
    return t["orders"].where(F.col("o_orderdate") == greatest(t["orders"], "o_orderdate"))


@query("""
WITH texts AS (SELECT 'code' AS kind, string_split(text, ' ') AS w FROM benchmark
               UNION ALL SELECT DISTINCT 'text', string_split(text, ' ') FROM documents),
runs AS (SELECT DISTINCT kind, array_to_string(w[i:i + n - 1], ' ') AS code
         FROM (SELECT kind, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (VALUES (1), (2), (3)) v(n)))
SELECT code FROM runs WHERE kind = 'code' INTERSECT SELECT code FROM runs WHERE kind = 'text'
""")
def token_contains_semi(t: Tables) -> DataFrame:
    """Codes of one to three words (every run of a benchmark text) that stand between blanks in a document."""
    words, n = F.col("words"), F.col("n")
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    codes = (
        t["benchmark"]
        .select(F.split("text", " ").alias("words"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n"))
        .where(F.size(words) >= n)
        .select(F.explode(runs).alias("code"))
        .distinct()
    )
    return contains_words(codes, "code", t["documents"], "text")


@query("""
WITH c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, u.turn AS user_turn, a.turn AS assistant_turn, s.turn AS system_turn FROM c
LEFT JOIN conversations u ON u.conv_id = c.conv_id AND u.role = 'user'
LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant'
LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.role = 'system'
""")
def eav_multi_left_join(t: Tables) -> DataFrame:
    """Every combination of a conversation's turns by role; a role without turns leaves NULL."""
    talk = t["conversations"]
    typed = [(talk.where(F.col("role") == role).select("conv_id", F.col("turn").alias(f"{role}_turn")), f"{role}_turn") for role in ("user", "assistant", "system")]
    return combinations(talk.select("conv_id").distinct(), "conv_id", typed)


# --- set operations ---------------------------------------------------------


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
def union_distinct(t: Tables) -> DataFrame:
    arms = [
        t["customer"].select(F.col("c_nationkey").alias("nationkey")),
        t["supplier"].select(F.col("s_nationkey").alias("nationkey")),
        t["nation"].select(F.col("n_regionkey").alias("nationkey")),
    ]
    return arms[0].union(arms[1]).union(arms[2]).distinct()


@query("SELECT c_name AS name, 'C' AS kind FROM customer UNION ALL SELECT s_name, 'S' FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return t["customer"].select(F.col("c_name").alias("name"), F.lit("C").alias("kind")).union(
        t["supplier"].select("s_name", F.lit("S"))
    )


@query("""
SELECT number, name, 'S' AS origin FROM (SELECT s_suppkey AS number, s_name AS name FROM supplier)
UNION ALL SELECT c_custkey, c_name, 'C' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT p_partkey, p_name, 'P' FROM part WHERE p_partkey NOT IN (SELECT s_suppkey FROM supplier UNION SELECT c_custkey FROM customer)
""")
def priority_union(t: Tables) -> DataFrame:
    """Three sources in order of trust; a later one only fills gaps."""
    s = t["supplier"].select(F.col("s_suppkey").alias("number"), F.col("s_name").alias("name"), F.lit("S").alias("origin"))
    c = t["customer"].select(F.col("c_custkey").alias("number"), F.col("c_name").alias("name"), F.lit("C").alias("origin"))
    p = t["part"].select(F.col("p_partkey").alias("number"), F.col("p_name").alias("name"), F.lit("P").alias("origin"))
    known = s.select("number").union(c.select("number")).distinct()
    return s.union(c.join(s, "number", "left_anti")).union(p.join(known, "number", "left_anti"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer ORDER BY c_nationkey, c_name")
def ordered_result(t: Tables) -> DataFrame:
    """Order is asked for by the caller, never part of a dataset."""
    return t["customer"].select("c_custkey", "c_name", "c_nationkey").orderBy("c_nationkey", "c_name")
