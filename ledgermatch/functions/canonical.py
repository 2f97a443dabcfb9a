"""Canonical text of a value, so that two sides of different type can be compared.

The text is what Python's ``str`` gives for the value, because that is the
comparison the checks define: the integer 1 equals the text '1', but not '1.0'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shown for NULL in samples and used as the sort text of NULL. Comparison itself
#: is null-safe, so a real text of this spelling never equals NULL.
NULL_TEXT = "__NULL__"

_PLAIN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType,
          T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType, T.BinaryType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def fold_nan(value: Column, dtype: T.DataType) -> Column:
    """NaN is NULL: the checks know one kind of missing value."""
    return F.when(~F.isnan(value), value) if isinstance(dtype, _FLOAT) else value


def _has_float(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_float(f.dataType) for f in dtype)
    if isinstance(dtype, T.ArrayType):
        return _has_float(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_float(dtype.valueType)
    return isinstance(dtype, _FLOAT)


def fold_nan_inside(value: Column, dtype: T.DataType) -> Column:
    """``fold_nan`` at any depth of structs, arrays and map values."""
    if not _has_float(dtype) or isinstance(dtype, _FLOAT):
        return fold_nan(value, dtype)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: fold_nan_inside(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, x: fold_nan_inside(x, dtype.valueType))
    members = [fold_nan_inside(value.getField(f.name), f.dataType).alias(f.name) for f in dtype]
    return F.when(value.isNotNull(), F.struct(*members))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def float_text(value: Column) -> Column:
    """Shortest decimal text in Python's layout (plain from 1e-4 up to 1e16).

    A short text without exponent is already right. The rest is written with the
    fewest of 15, 16 or 17 digits that give the same number, since older Java
    versions may write one digit too many. With such a version the last of 17
    digits can, very rarely, be the neighbouring one that gives the same number.
    This only matters where a number meets text on the other side.
    """
    value = value.cast("string").cast("double")  # a FLOAT by its own digits
    text = value.cast("string")

    def in_digits(n: int) -> Column:
        return F.format_string(f"%.{n - 1}e", value)

    def same(candidate: Column) -> Column:
        return candidate.cast("double") == value

    fewest = (
        F.when(same(in_digits(15)), in_digits(15)).when(same(in_digits(16)), in_digits(16)).otherwise(in_digits(17))
    )

    def parts(scientific: Column) -> Column:
        digits = F.regexp_replace(F.substring_index(scientific, "e", 1), "[-.]", "")
        return F.struct(
            F.regexp_replace(digits, "(?<=.)0+$", "").alias("digits"),
            F.substring_index(scientific, "e", -1).cast("int").alias("exponent"),
        )

    def laid_out(p: Column) -> Column:
        digits, exponent = p["digits"], p["exponent"]
        whole = F.rpad(digits, exponent + 1, "0")  # also cuts longer digits
        fraction = F.substr(digits, exponent + 2)
        power = F.abs(exponent).cast("string")
        return (
            F.when(
                (exponent >= 0) & (exponent < 16),
                F.concat(whole, F.lit("."), F.when(fraction == "", "0").otherwise(fraction)),
            )
            .when(
                (exponent < 0) & (exponent >= -4),
                F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits),
            )
            .otherwise(
                F.concat(
                    F.left(digits, F.lit(1)),
                    F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
                    F.when(exponent < 0, "e-").otherwise("e+"),
                    F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power),
                )
            )
        )

    sign = F.when(value < 0, "-").otherwise("")
    return (
        F.when(value.isNull() | F.isnan(value), None)
        .when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when((F.length(text) <= 17) & ~F.contains(text, F.lit("E")), text)
        .otherwise(F.concat(sign, _let(fewest, lambda s: _let(parts(s), laid_out))))
    )


def timestamp_text(value: Column) -> Column:
    """ISO text with a blank; six fraction digits or none."""
    text = value.cast("string")  # leaves out the zeros at the end of a fraction
    return F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)


def _json_string(value: Column) -> Column:
    """A quoted JSON string: the one element of a JSON array, brackets removed."""
    array = F.to_json(F.array(value))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def json_text(value: Column, dtype: T.DataType) -> Column:
    """JSON text with sorted keys and ', ' and ': ' as separators; NULL is ``null``."""
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        members = [
            F.concat(_json_string(F.lit(f.name)), F.lit(": "), json_text(value.getField(f.name), f.dataType))
            for f in fields
        ]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: json_text(item, dtype.elementType))
        body = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        entries = F.transform(
            F.map_entries(value),
            lambda entry: F.struct(
                canonical_text(entry["key"], dtype.keyType).alias("k"),
                json_text(entry["value"], dtype.valueType).alias("v"),
            ),
        )
        pairs = F.transform(F.array_sort(entries), lambda e: F.concat(_json_string(e["k"]), F.lit(": "), e["v"]))
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(dtype, T.VariantType):
        body = F.to_json(value)
    elif isinstance(dtype, T.BooleanType):
        body = value.cast("string")
    elif isinstance(dtype, _WHOLE + _FLOAT):
        body = canonical_text(value, dtype)
    elif isinstance(dtype, T.NullType):
        body = F.lit(None).cast("string")
    else:
        body = _json_string(canonical_text(value, dtype))
    return F.when(value.isNull(), "null").otherwise(F.coalesce(body, F.lit("null")))


def canonical_text(value: Column, dtype: T.DataType) -> Column:
    """Canonical text of any value; NULL and NaN stay NULL."""
    if isinstance(dtype, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    if isinstance(dtype, _FLOAT):
        return float_text(value)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(value)
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if is_nested(dtype):
        return F.when(value.isNotNull(), json_text(value, dtype))
    return value.cast("string")


def comparison_key(value: Column, dtype: T.DataType, other: T.DataType) -> Column:
    """``value`` in a form that can be grouped with a value of type ``other``.

    Equal simple types (for text: with equal collation) are grouped as they are,
    whole numbers as BIGINT; everything else goes through its canonical text.
    """
    if dtype == other and isinstance(dtype, _PLAIN + _FLOAT):
        return fold_nan(value, dtype)
    if isinstance(dtype, _WHOLE) and isinstance(other, _WHOLE):
        return value.cast("bigint")
    return canonical_text(value, dtype)


def sort_text(value: Column, dtype: T.DataType) -> Column:
    return F.coalesce(canonical_text(value, dtype), F.lit(NULL_TEXT))
