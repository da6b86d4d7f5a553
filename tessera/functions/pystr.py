"""Values as text, and the kind of a value, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_TEXT = r"(?i)^\s*[+-]?(nan|inf(inity)?|(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?)\s*$"
BLANK_TEXT = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]*$"


def float_str(c: Column) -> Column:
    """The shortest text, as far as the JVM finds it, that reads back as the same double: plain from 1e-4 to 1e16, else scientific."""
    short, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(short.try_cast("decimal(38,21)").cast("string"), r"(\.\d*?)0+$", "$1")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    digits = F.regexp_replace(F.substring_index(short, "E", 1), r"\.0$", "")
    power = F.substring_index(short, "E", -1)
    size_of = F.regexp_replace(power, "-", "")
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    science = F.concat(digits, F.lit("e"), sign, F.when(F.length(size_of) < 2, F.lpad(size_of, 2, "0")).otherwise(size_of))
    return (
        F.when(F.isnan(c), "nan")
        .when(size == float("inf"), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-3) & (size < 1e7) | (size == 0), short)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(science)
    )


def python_str(c: Column, kind: T.DataType) -> Column:
    """Text of a value of the given type; null stays null."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float_str(c.cast("double"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        micros = F.date_format(c, "SSSSSS")
        return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
    if isinstance(kind, T.BinaryType):
        return F.make_valid_utf8(c.cast("string"))
    return c.cast("string")


def string_kind(v: Column, dates: Column | None = None) -> Column:
    """The kind of a non-null text; dates: whether it matches a date pattern, where dates are looked for."""
    digits = v.rlike(r"^\p{Nd}+$")
    out = F.when(v.rlike(BLANK_TEXT), "empty").when(digits & v.startswith("0"), "numstr").when(digits, "int").when(v.rlike(FLOAT_TEXT), "float")
    return (out if dates is None else out.when(dates, "date")).otherwise("str")


def value_kind(c: Column, kind: T.DataType, dates: Column | None = None) -> Column:
    fixed = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.DateType: "date"}
    if isinstance(kind, T.StringType):
        known = string_kind(c, dates)
    else:
        known = F.lit(fixed.get(type(kind), "typed"))
    return F.when(c.isNull(), "empty").otherwise(known)


def int_size(c: Column) -> Column:
    """The smallest unsigned integer type that holds a number, as the profiler names it."""
    return F.when(c < 256, "uint8").when(c < 65536, "uint16").otherwise("uint32")


def number(v: Column) -> Column:
    """The double that a text of kind int, numstr or float stands for."""
    t = F.lower(F.replace(F.regexp_replace(v, r"^\s+|\s+$", ""), F.lit("_"), F.lit("")))
    return t.try_cast("double")


def confidence_text(c: Column) -> Column:
    """Two decimals, halves to even."""
    return F.format_string("%.2f", F.bround(c, 2))
