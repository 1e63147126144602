"""Text values of any notation as typed values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import strip
from .stage import staged

# The words for booleans and for missing text.
TRUE_WORDS = ("true", "yes", "t", "y", "on", "1")
FALSE_WORDS = ("false", "no", "f", "n", "off", "0")
MISSING_WORDS = ("na", "none", "null", "nan", "")

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
GROUPED = r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$"


def number_text(value: Column) -> Column:
    """The number in a text without blanks around it and group separators, null if the text is no number."""
    plain = F.when(value.rlike(GROUPED), F.regexp_replace(value, ",", "")).otherwise(value)
    return F.when(plain.rlike(NUMBER), plain)


def as_integer(number: Column) -> Column:
    """BIGINT of a number_text without fraction; null for others and beyond 64 bits."""
    exact = number.try_cast("decimal(38,18)")
    return F.when(number.rlike(r"^[+-]?\d+$"), number.try_cast("bigint")).when(exact == F.floor(exact), exact.try_cast("bigint"))


def as_double(number: Column) -> Column:
    """DOUBLE of a finite number_text, null for others; minus zero is zero."""
    d = number.try_cast("double")
    return F.when(F.abs(d) <= 1.7976931348623157e308, d + F.lit(0.0))


def as_boolean(value: Column) -> Column:
    """BOOLEAN of one of the usual words, letters and digits, blanks around it removed."""
    s = F.lower(value)
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def as_text(value: Column) -> Column:
    """The text unless it is a word for a missing value, blanks around it removed."""
    return F.when(~F.lower(value).isin(*MISSING_WORDS), value)


def parsed(value: Column, kind: str) -> Column:
    """A stripped text as the Spark type of kind, null if it is not of it."""
    return {"integer": lambda v: as_integer(number_text(v)), "double": lambda v: as_double(number_text(v)), "boolean": as_boolean, "text": as_text}[kind](value)


#: value_type -> Spark type
TYPES = {"integer": "bigint", "double": "double", "boolean": "boolean", "text": "string"}


def cell(column: Column, kind: str) -> Column:
    """A typed value as text: plain digits, six decimals, true or false, the text itself."""
    return F.when(column.isNotNull(), F.format_string("%.6f", column)) if kind == "double" else column.cast("string")


def with_cell(df: DataFrame, value: str, kind: str) -> DataFrame:
    """Add cell, the text form of value in the row's own type (null if it is not of that type), and raw, all digits of it."""
    k = F.col(kind)
    df = staged(df, _v=strip(F.col(value)))
    df = staged(df, _n=F.when(k.isin("integer", "double"), number_text(F.col("_v"))))
    df = staged(df, _d=F.when(k == "double", as_double(F.col("_n"))))
    other = F.when(k == "integer", as_integer(F.col("_n")).cast("string")).when(k == "boolean", as_boolean(F.col("_v")).cast("string")).when(k == "text", as_text(F.col("_v")))
    df = staged(df, _o=other)
    return df.withColumns({"cell": F.coalesce(cell(F.col("_d"), "double"), F.col("_o")), "raw": F.coalesce(F.col("_d").cast("string"), F.col("_o"))}).drop("_v", "_n", "_d", "_o")
