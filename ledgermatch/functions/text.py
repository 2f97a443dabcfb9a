"""Text expressions with the NULL rules of the source databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def string_agg(
    value: str,
    sep: str,
    order_by: list[str] | None = None,
    where: str | None = None,
    max_len: int | None = None,
) -> Column:
    """Ordered string aggregate over column ``value``.

    NULL values are skipped and a group of only NULLs gives NULL. ``order_by``
    names the ordering columns (default: the value itself). ``where`` is a SQL
    predicate that limits the rows of this one aggregate. ``max_len`` cuts the
    result, which imitates a database with a length-limited aggregate; the
    default keeps it whole.
    """
    order = ", ".join(_name(c) for c in (order_by or [value]))
    text = f"listagg({_name(value)}, {_quoted(sep)}) WITHIN GROUP (ORDER BY {order})"
    if where is not None:
        text += f" FILTER (WHERE {where})"
    agg = F.expr(text)
    return agg if max_len is None else F.left(agg, F.lit(max_len))


def distinct_text_agg(value: Column, sep: str) -> Column:
    """Sorted distinct non-NULL texts joined by ``sep``; NULL if there are none.

    ``collect_set`` drops repeats on the map side, so the shuffle and the final
    buffer hold no more than the distinct texts that make up the result cell.
    """
    texts = F.array_sort(F.collect_set(value))
    return F.when(F.size(texts) > 0, F.array_join(texts, sep))


def concat_blank(*parts: Column) -> Column:
    """Concatenate, reading NULL as the empty string."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def concat_strict(*parts: Column) -> Column:
    """Concatenate; any NULL makes the result NULL."""
    return F.concat(*parts)


def joined_or_null(sep: str, *parts: Column) -> Column:
    """Join the non-NULL parts; NULL when nothing (or only blanks) is left."""
    return F.nullif(F.concat_ws(sep, *parts), F.lit(""))


def blank_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def length_without_trailing_blanks(value: Column) -> Column:
    return F.length(F.rtrim(value))


def null_text() -> Column:
    """A NULL with a type: an untyped NULL column cannot be written to Parquet."""
    return F.lit(None).cast("string")


def collated(df: DataFrame, collation: str) -> DataFrame:
    """Give every text column a collation, such as the source database's.

    Equality, grouping, joins and order then follow it. ``UTF8_LCASE`` ignores
    case, ``UTF8_BINARY_RTRIM`` trailing blanks; the default compares bytes.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({name: F.collate(F.col(f"`{name}`"), collation) for name in texts})
