"""Streaming extension: periods per entity kept up to date while intervals arrive, in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import IntervalMap

OUTPUT = "entity string, kind string, range_start bigint, range_end bigint"
STATE = "starts array<bigint>, ends array<bigint>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    before = set(m.periods()), set(m.gaps())
    for b in batches:
        for lo, hi in zip(b["lo"], b["hi"]):
            m.insert(int(lo), int(hi))
    state.update((m.starts, m.ends))
    fresh = [(key[0], "period", *p) for p in m.periods() if p not in before[0]] + [(key[0], "gap", *g) for g in m.gaps() if g not in before[1]]
    yield pd.DataFrame(fresh, columns=["entity", "kind", "range_start", "range_end"])


def stream_periods(stream: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """The periods and gaps that each micro-batch changed (update mode). The state of an entity is its disjoint periods,
    not its intervals; order of arrival and repeated rows do not matter; rows with a null end or entity are left out."""
    rows = stream.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(entity).isNotNull())
    rows = rows.select(F.col(entity).cast("string").alias("entity"), F.least(start, end).cast("bigint").alias("lo"), F.greatest(start, end).cast("bigint").alias("hi"))
    return rows.groupBy("entity").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
