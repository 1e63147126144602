"""Ordered operators (previous row, running totals) over groups of any size.

A plain window sorts one group in one task. Here groups above `target` rows are cut into chunks along the ordering
columns; windows run per chunk and only one carry row per chunk is exchanged between chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Rows of one group that one task handles; larger groups are cut.
CHUNK_ROWS = 500_000
#: Most chunks of all cut groups together (chunks grow beyond it) and rows drawn to place one cut: they bound what is broadcast.
MAX_CHUNKS, DRAWN = 20_000, 32
CHUNK = "_chunk"
BLOCK = 64


@dataclass
class Chunked:
    """rows: df with the column _chunk (0 for groups that are not cut); hot: the keys of the cut groups (_hot_k0, _hot_k1, ...), None if there are none."""

    rows: DataFrame
    hot: DataFrame | None


def _chunk_of(x: Column) -> Column:
    """How many of the sorted _hot_bounds are at most x: blocks first, then inside one block."""
    before = F.size(F.filter("_hot_heads", lambda b: b <= x)) - 1
    inside = F.size(F.filter(F.slice("_hot_bounds", F.greatest(before, F.lit(0)) * BLOCK + 1, BLOCK), lambda b: b <= x))
    return F.when(before < 0, 0).otherwise(before * BLOCK + inside)


def chunked(df: DataFrame, keys: list[str], order: list[str], target: int = CHUNK_ROWS) -> Chunked:
    """Add _chunk so that no (keys, _chunk) holds much more than target rows and chunks are ranges of order, a column list
    of any types, nulls first.

    Counts every group (partial aggregation, one small row per group) and looks only for those above target. These are cut
    at quantiles of the order columns, estimated from about DRAWN rows a chunk, so outliers and skewed values don't matter;
    a wrong estimate changes the size of chunks only. Rows that are equal in all order columns stay together. Rows are
    neither dropped nor reordered.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_hot_n")).where(F.col("_hot_n") > target)
    found = counts.limit(MAX_CHUNKS + 1).collect()
    if not found:
        return Chunked(df.withColumn(CHUNK, F.lit(0)), None)
    if len(found) > MAX_CHUNKS:  # more than MAX_CHUNKS times target rows: cut into larger chunks
        target = -(-counts.agg(F.sum("_hot_n")).first()[0] // MAX_CHUNKS)
        found = counts.where(F.col("_hot_n") > target).collect()
        if not found:
            return Chunked(df.withColumn(CHUNK, F.lit(0)), None)
    target = max(target, -(-sum(r["_hot_n"] for r in found) // MAX_CHUNKS))
    own = [f"_hot_k{i}" for i in range(len(keys))]
    hot = df.sparkSession.createDataFrame(found, counts.schema).toDF(*own, "_hot_n").withColumn("_hot_cut", F.ceil(F.col("_hot_n") / target))
    on = F.lit(True)
    for k, o in zip(keys, own):
        on = on & F.col(k).eqNullSafe(F.col(o))
    x = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])
    drawn = df.join(F.broadcast(hot), on).where(F.rand(17) * F.col("_hot_n") < F.col("_hot_cut") * DRAWN).select(*own, "_hot_cut", x.alias("_hot_x"))
    some = drawn.groupBy(*own).agg(F.max("_hot_cut").alias("_hot_cut"), F.sort_array(F.collect_list("_hot_x")).alias("_hot_all"))
    pick = F.transform(F.sequence(F.lit(1), F.col("_hot_cut")), lambda i: F.get("_hot_all", F.floor(F.size("_hot_all") * i / F.col("_hot_cut")).cast("int")))
    some = some.select(*own, F.array_distinct(F.array_compact(pick)).alias("_hot_bounds"))
    # written once: every later use sees the same cuts
    some = materialise(some.withColumn("_hot_heads", F.filter("_hot_bounds", lambda b, i: i % BLOCK == 0)), "chunks")
    rows = df.join(F.broadcast(some), on, "left").withColumn(CHUNK, F.coalesce(_chunk_of(x), F.lit(0)).cast("int"))
    return Chunked(rows.drop("_hot_bounds", "_hot_heads", *own), some.select(*own))


def _same(a: str, b: str, names: list[str]) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return on


def previous(df: DataFrame, keys: list[str], order: list[str], cols: list[str], out: str = "previous", target: int = CHUNK_ROWS) -> DataFrame:
    """Add the struct column out: cols of the row before, by order, within keys; null for the first row.

    The last entries of order must break ties. Groups above target rows are cut into chunks along order.
    """
    c = chunked(df, keys, order, target)
    value = F.struct(*cols)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = c.rows.withColumn(out, F.lag(value).over(w))
    if c.hot is None:
        return rows.drop(CHUNK)
    last = c.rows.groupBy(*keys, CHUNK).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK))).where(F.col(CHUNK) > 0)
    joined = rows.alias("r").join(carry.drop("_last").alias("c"), _same("r", "c", [*keys, CHUNK]), "left")
    return joined.select(*[f"r.{n}" for n in df.columns], F.coalesce(F.col(f"r.{out}"), F.col("c._carry")).alias(out))


def _running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], target: int, fold, join) -> DataFrame:
    temp = {f"_v{i}": v for i, v in enumerate(values.values())}
    c = chunked(df.withColumns(temp), keys, order, target)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = c.rows.withColumns({n: fold(t).over(w) for n, t in zip(values, temp)})
    if c.hot is None:
        return rows.drop(CHUNK, *temp)
    parts = c.rows.groupBy(*keys, CHUNK).agg(*[fold(t).alias(t) for t in temp])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, CHUNK, *[fold(t).over(before).alias(f"_c{t}") for t in temp]).where(F.col(CHUNK) > 0)
    joined = rows.alias("r").join(carry.alias("c"), _same("r", "c", [*keys, CHUNK]), "left")
    total = [F.coalesce(join(F.col(f"r.{n}"), F.col(f"c._c{t}")), F.col(f"r.{n}"), F.col(f"c._c{t}")).alias(n) for n, t in zip(values, temp)]
    return joined.select(*[f"r.{n}" for n in df.columns], *total)


def running_sum(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], target: int = CHUNK_ROWS) -> DataFrame:
    """Add running sums (current row included) of values by order within keys, one column per entry."""
    return _running(df, keys, order, values, target, F.sum, lambda a, b: a + b)


def running_max(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], target: int = CHUNK_ROWS) -> DataFrame:
    """Add running maxima (current row included) of values by order within keys, one column per entry."""
    return _running(df, keys, order, values, target, F.max, F.greatest)


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, target: int = CHUNK_ROWS) -> DataFrame:
    """Add out: the last non-null value at or before the row, by order within keys (an as-of lookup after a union)."""
    c = chunked(df, keys, order, target)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = c.rows.withColumn(out, F.last(value, ignorenulls=True).over(w))
    if c.hot is None:
        return rows.drop(CHUNK)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    last = c.rows.groupBy(*keys, CHUNK).agg(F.max_by(value, known).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, CHUNK, F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    joined = rows.alias("r").join(carry.alias("c"), _same("r", "c", [*keys, CHUNK]), "left")
    return joined.select(*[f"r.{n}" for n in df.columns], F.coalesce(F.col(f"r.{out}"), F.col("c._carry")).alias(out))
