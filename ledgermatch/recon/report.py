"""Reports as DataFrames: summary, totals, details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermatch.recon.verdict import BOTH_EMPTY, ERROR, FAIL, NULL, ONE_EMPTY, PASS


def _tag(passed: Column) -> Column:
    return F.when(passed, PASS).otherwise(FAIL)


def status(rows_count: Column, columns: Column, data: Column) -> Column:
    """Overall status of the three tags of a dataset."""
    tags = F.array(rows_count, columns, data)
    return (
        F.when((columns == NULL) | (data == NULL), ERROR)
        .when(F.forall(tags, lambda tag: tag == PASS), PASS)
        .when(F.array_contains(tags, ERROR), ERROR)
        .otherwise(FAIL)
    )


def summary(results: DataFrame, *carry: str) -> DataFrame:
    """One row per dataset: name, the result columns in ``carry``, rows_count, columns, data, status."""
    failed_input = F.col("error_message").isNotNull()
    both_empty = F.col("data.reason") == BOTH_EMPTY

    def tag(passed: Column) -> Column:
        return F.when(failed_input, ERROR).when(both_empty, NULL).otherwise(_tag(passed))

    tags = results.select(
        "name",
        *carry,
        tag(F.col("row_count_passed")).alias("rows_count"),
        tag(F.col("columns.passed")).alias("columns"),
        tag(F.col("data.passed")).alias("data"),
    )
    return tags.withColumn("status", status(F.col("rows_count"), F.col("columns"), F.col("data")))


def totals(summary_rows: DataFrame) -> DataFrame:
    """Number of datasets per status, in one row."""
    return summary_rows.agg(
        F.count_if(F.col("status") == PASS).alias("total_passed"),
        F.count_if(F.col("status") == FAIL).alias("total_failed"),
        F.count_if(F.col("status") == ERROR).alias("total_errors"),
    )


def details(results: DataFrame) -> DataFrame:
    """One row per dataset and check: name, check, outcome, detail.

    The checks are row_count_check, column_name_consistency and
    full_data_verification; a dataset without data also gets an error_message
    row.
    """
    failed_input = F.col("error_message").isNotNull()
    both_empty = F.col("data.reason") == BOTH_EMPTY
    one_empty = F.col("data.reason") == ONE_EMPTY
    counts = F.format_string("src=%d, trg=%d", F.col("src_count"), F.col("trg_count"))

    def listed(names: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(names, ", "), F.lit("]"))

    same_order = F.concat(F.lit("same_order="), F.initcap(F.col("columns.same_order").cast("string")))
    columns_detail = F.when(F.col("columns.passed"), same_order).otherwise(
        F.concat(
            same_order,
            F.lit("; missing_in_trg: "),
            listed(F.col("columns.missing_in_trg")),
            F.lit("; missing_in_src: "),
            listed(F.col("columns.missing_in_src")),
        )
    )
    data_detail = F.when(
        F.col("data.passed") | F.col("data.src_only_count").isNull(), F.col("data.reason")
    ).otherwise(
        F.concat(
            F.col("data.reason"),
            F.format_string(
                "; src_only_rows: %d; trg_only_rows: %d",
                F.col("data.src_only_count"),
                F.col("data.trg_only_count"),
            ),
        )
    )

    def line(check: str, outcome: Column, detail: Column) -> Column:
        return F.struct(F.lit(check).alias("check"), outcome.alias("outcome"), detail.alias("detail"))

    def outcome(passed: Column) -> Column:
        return F.when(failed_input, ERROR).when(both_empty, NULL).otherwise(_tag(passed))

    def skipping(detail: Column) -> Column:
        return F.when(failed_input | both_empty, None).when(one_empty, "Skipping").otherwise(detail)

    message = F.when(failed_input, F.col("error_message")).when(
        both_empty, "there is no data for comparison"
    )
    lines = F.array(
        F.when(message.isNotNull(), line("error_message", F.lit(ERROR), message)),
        line("row_count_check", outcome(F.col("row_count_passed")), F.when(~failed_input, counts)),
        line("column_name_consistency", outcome(F.col("columns.passed")), skipping(columns_detail)),
        line("full_data_verification", outcome(F.col("data.passed")), skipping(data_detail)),
    )
    return results.select("name", F.inline(F.array_compact(lines)))
