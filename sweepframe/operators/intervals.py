"""Overlapping and gapped intervals: continuous periods and the gaps between them, per entity.

Method: an ordered disjoint-interval map per entity in keyed state; each insertion finds the overlapped stretch by
binary search, merges it and so updates the gaps. Rows are hashed by entity (and by chunk of the starts for entities
above MAP_ROWS rows), sorted by that key within the partition, and streamed through one map at a time. Periods of
entities that were cut into chunks are stitched across chunk borders afterwards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import CHUNK, _same, chunked, previous

#: Intervals of one entity in one map: insertion moves what lies behind it, so maps stay smaller than sorted groups.
MAP_ROWS = 100_000


class IntervalMap:
    """Disjoint closed integer intervals in order; touching ones (end + 1 = start) are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])

    def insert(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start - 1), bisect_right(self.starts, end + 1)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]


def _fold(batches: Iterator[pa.RecordBatch], entity: pa.DataType, with_gaps: bool) -> Iterator[pa.RecordBatch]:
    """Rows (entity, _chunk, lo, hi) sorted by entity and _chunk -> (entity, _chunk, kind, range_start, range_end)."""
    out: list[list] = [[], [], [], [], []]
    at, state = None, IntervalMap()

    def close() -> None:
        for kind, rows in (("period", state.periods()), ("gap", state.gaps() if with_gaps else [])):
            for s, e in rows:
                for column, v in zip(out, (at[0], at[1], kind, s, e)):
                    column.append(v)

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (entity, pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["entity", CHUNK, "kind", "range_start", "range_end"])
        for c in out:
            c.clear()
        return batch

    for b in batches:
        for key in zip(*(b.column(i).to_pylist() for i in range(4))):
            if key[:2] != at:
                if at is not None:
                    close()
                    if len(out[0]) >= 8192:
                        yield flush()
                at, state = key[:2], IntervalMap()
            state.insert(key[2], key[3])
    if at is not None:
        close()
    if out[0]:
        yield flush()


def _maps(rows: DataFrame, with_gaps: bool) -> DataFrame:
    kind = rows.schema["entity"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    spread = rows.select("entity", CHUNK, "lo", "hi").distinct().repartition("entity", CHUNK).sortWithinPartitions("entity", CHUNK)
    return spread.mapInArrow(lambda it: _fold(it, arrow, with_gaps), f"entity {kind.simpleString()}, {CHUNK} int, kind string, range_start bigint, range_end bigint")


def _stitch(parts: DataFrame, target: int) -> DataFrame:
    """Join periods across chunks: a period that reaches no further than one before it plus 1 belongs to it."""
    ends = parts.groupBy("entity", CHUNK).agg(F.max("range_end").alias("_top"))
    before = Window.partitionBy("entity").orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("entity", CHUNK, F.max("_top").over(before).alias("_carry"))
    w = Window.partitionBy("entity", CHUNK).orderBy("range_start")
    rows = parts.alias("p").join(ends.alias("e"), _same("p", "e", ["entity", CHUNK])).select("p.*", "_carry")
    reach = F.greatest(F.col("_carry"), F.lag("range_end").over(w))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("range_start") > reach + 1), 1).otherwise(0))
    news = rows.groupBy("entity", CHUNK).agg(F.sum("_new").alias("_n"))
    news = news.select("entity", CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside).alias("r").join(news.alias("n"), _same("r", "n", ["entity", CHUNK]))
    islands = rows.groupBy(F.col("r.entity").alias("entity"), (F.col("_inside") + F.col("_first")).alias("_island")).agg(F.min("range_start").alias("range_start"), F.max("range_end").alias("range_end"))
    both = previous(materialise(islands.select("entity", "range_start", "range_end"), "islands"), ["entity"], ["range_start"], ["range_end"], "_before", target)
    period = F.struct(F.lit("period").alias("kind"), "range_start", "range_end")
    gap = F.when(F.col("_before").isNotNull(), F.struct(F.lit("gap").alias("kind"), (F.col("_before.range_end") + 1).alias("range_start"), (F.col("range_start") - 1).alias("range_end")))
    return both.select("entity", F.explode(F.array_compact(F.array(period, gap))).alias("p")).select("entity", "p.*")


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, target: int = MAP_ROWS) -> DataFrame:
    """Continuous periods of each entity and the gaps between successive ones, both ends included.

    Returns (entity column, kind 'period' | 'gap', range_start, range_end), one row each. The two ends of an interval
    may come in either order; rows with a null end do not count; touching intervals are continuous; repeated and nested
    rows change nothing; a null entity is an entity of its own; other columns are ignored; an empty table gives no rows.
    Entities above target rows are cut by ranges of the start, so no task holds more than about target intervals.
    """
    lo, hi = F.least(F.col(start), F.col(end)).cast("bigint"), F.greatest(F.col(start), F.col(end)).cast("bigint")
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(F.col(entity).alias("entity"), lo.alias("lo"), hi.alias("hi"))
    c = chunked(rows, ["entity"], ["lo", "hi"], target)
    if c.hot is None:
        out = _maps(c.rows, True)
    else:
        keys = F.broadcast(c.hot)
        on = F.col("entity").eqNullSafe(F.col("_hot_k0"))
        out = _maps(c.rows.join(keys, on, "left_anti"), True).drop(CHUNK)
        parts = materialise(_maps(c.rows.join(keys, on, "left_semi"), False).drop("kind"), "parts")  # read four times below
        out = out.unionByName(_stitch(parts, target))
    return out.select(F.col("entity").alias(entity), "kind", "range_start", "range_end")
