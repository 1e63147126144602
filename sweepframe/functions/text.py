"""Scalar functions of the readers and summaries: dates of falling precision, sequence clipping, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a month and a year in the date stamps.
MONTH_SECONDS, YEAR_SECONDS = 2_628_000, 31_536_000


def collection_date(text: Column) -> Column:
    """A date from dd-MMM-yyyy, MMM-yyyy or yyyy text (first day where parts are missing), null for anything else."""
    year = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01")))
    tries = [F.when(text.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.try_to_timestamp(text, F.lit("d-MMM-yyyy"))), F.when(text.rlike(r"^[A-Za-z]{3}-\d{4}$"), F.try_to_timestamp(text, F.lit("MMM-yyyy")))]
    return F.coalesce(*[t.cast("date") for t in tries], year.try_cast("date"))


def dated_precision(text: Column, unit: Column | None = None) -> Column:
    """'days_n', 'months_n' or 'years_n' since 1970 by the precision of the text (or the given unit), 'NA_0' if there is none."""
    days = F.date_diff(collection_date(text), F.lit("1970-01-01").cast("date"))
    unit = unit if unit is not None else F.when(text.rlike(r"^\d{1,2}-"), "days").when(text.rlike(r"^[A-Za-z]"), "months").otherwise("years")
    seconds = days.cast("bigint") * 86_400
    n = F.when(unit == "days", days.cast("bigint")).when(unit == "months", F.floor(seconds / MONTH_SECONDS)).otherwise(F.floor(seconds / YEAR_SECONDS))
    return F.when(days.isNull(), F.lit("NA_0")).otherwise(F.concat(unit, F.lit("_"), n.cast("bigint").cast("string")))


def clip_ranges(sequence: Column, ranges: Column) -> Column:
    """A gapped sequence without the positions in ranges (ARRAY<STRUCT<from, to>>), counted over its non-gap letters.

    Gap marks ('-') go with the letter before them; those before the first letter stay.
    """
    letters = F.regexp_extract_all(sequence, F.lit("(^-+(?=[^-])|[^-]-*)"), F.lit(1))
    lead = F.when(sequence.startswith("-"), 1).otherwise(0)
    kept = F.filter(F.transform(letters, lambda x, i: F.struct(x.alias("x"), (i + 1 - lead).alias("at"))), lambda e: ~F.exists(ranges, lambda r: (r["from"] <= e["at"]) & (e["at"] <= r["to"])))
    return F.array_join(F.transform(kept, lambda e: e["x"]), "")


def scientific(value: Column, digits: int = 1) -> Column:
    """LaTeX scientific notation of a number, or plain rounding between 0.01 and 1000."""
    e = F.floor(F.log10(F.abs(value)))
    sci = F.format_string(f"$%.{digits}f \\\\times 10^{{%d}}$", value / F.pow(F.lit(10.0), e), e.cast("int"))
    return F.when((value == 0) | F.abs(value).between(0.01, 1000), F.format_string(f"%.{digits}f", value)).otherwise(sci)
