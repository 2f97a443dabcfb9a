"""Clean-up of codes: prefixes, suffixes and numbers held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def strip_prefix(code: Column, prefix: str) -> Column:
    """Remove ``prefix`` once, only at the start."""
    return F.when(
        F.startswith(code, F.lit(prefix)), F.substring(code, len(prefix) + 1, 2147483647)
    ).otherwise(code)


def remove_all(code: Column, token: str) -> Column:
    """Remove every occurrence of ``token``, wherever it stands."""
    return F.replace(code, F.lit(token), F.lit(""))


def strip_suffix(value: Column, suffix: str = "M") -> Column:
    """Remove one trailing ``suffix``; a repeated suffix loses only the last one."""
    return F.when(
        F.endswith(value, F.lit(suffix)), F.left(value, F.length(value) - len(suffix))
    ).otherwise(value)


def leading_digits(value: Column) -> Column:
    """The run of ASCII digits at the start, '' if there is none."""
    return F.regexp_extract(value, "^[0-9]*", 0)


def to_bigint(value: Column) -> Column:
    """Text to BIGINT, error on bad text; blank text is 0 as in SQL Server."""
    return F.when(F.trim(value) == "", F.lit(0).cast("bigint")).otherwise(value.cast("bigint"))


def try_to_bigint(value: Column) -> Column:
    """Text to BIGINT, NULL on bad text; blank text is 0 as in SQL Server."""
    return F.when(F.trim(value) == "", F.lit(0).cast("bigint")).otherwise(value.try_cast("bigint"))
