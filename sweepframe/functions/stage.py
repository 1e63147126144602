"""Staged projection and zone-free time numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns that later stages don't inline: each expression is evaluated once per row.

    Catalyst merges stacked projections and repeats an expression wherever it is used; parsers built of several steps
    grow exponentially that way. A one-element generator between the steps keeps them apart, inside the JVM.
    """
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.explode(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))).alias("_stage")).select(*keep, "_stage.*")


def micros(df: DataFrame, name: str) -> Column:
    """Micros since 1970 of a timestamp column; one without zone counts as UTC, whatever the session's zone."""
    c = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(c)
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * DAY_MICROS + (F.hour(c) * 60 + F.minute(c)).cast("bigint") * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
