"""Entity-attribute-value rows into wide typed tables.

Method: positional stitching. Entities are hashed into ordinal ranges (blocks) and ordered inside; every attribute is
written as a typed column aligned to the ordinals of a range, and the columns are assembled by position into Arrow
batches. Cells are parsed once and reduced to the different values of an entity and attribute on the map side; a block holds
at most one cell per entity and attribute, and values that disagree are kept in a long table beside the wide one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import strip, with_parameter
from ..functions.values import TYPES, cell, with_cell
from ..session import bounded_rows, materialise

#: Cells per ordinal range at most; there are never fewer ranges than shuffle partitions.
BLOCK_ROWS = 500_000
ARROW = {"integer": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "text": pa.string()}


def typed_cells(df: DataFrame, types: DataFrame, aliases: DataFrame, entity: str = "path", attribute: str = "parameter", value: str = "value") -> DataFrame:
    """(entity, parameter, value_type, cell, raw): rows whose attribute is known and whose value fits its type.

    raw keeps all digits of a double. Rows without entity (null or blank), with a null or unknown attribute, or with a
    value that is not of the type give no row.
    """
    kinds = {r.parameter: r.value_type for r in bounded_rows(types.select("parameter", "value_type")) or [] if r.parameter is not None}
    rows = df.where(F.col(entity).isNotNull() & (strip(F.col(entity)) != "")).select(F.col(entity).alias("entity"), F.col(attribute).alias("_a"), F.col(value).alias("_v"))
    rows = with_parameter(rows, "_a", types, aliases, "parameter").where("parameter is not null")
    if kinds:
        rows = rows.withColumn("value_type", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("parameter")])
    else:
        rows = rows.join(types.select("parameter", "value_type").dropDuplicates(["parameter"]), "parameter")
    return with_cell(rows.select("entity", "parameter", "value_type", "_v"), "_v", "value_type").where("cell is not null")


def _assemble(batches: Iterator[pa.RecordBatch], names: list[str], kinds: dict[str, str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cells (block, entity, position of the attribute, raw, more) sorted by block and entity -> wide batches.

    The ordinals of a batch's cells are counted at once and every column is taken by position; only the cells of the last
    entity, which may go on, wait for the next batch.
    """
    block, next_ordinal = -1, 0

    def wide(t: pa.Table) -> pa.RecordBatch:
        nonlocal block, next_ordinal
        t = t.combine_chunks()
        blocks, who, at, more = t.column(0).to_numpy(), t.column(1), t.column(2).to_numpy(), t.column(4).to_numpy(zero_copy_only=False)
        code = who.combine_chunks().dictionary_encode().indices.to_numpy()
        fresh = np.r_[True, (code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])]
        row, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        own = blocks[first].astype(np.int64)
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        inside = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
        inside += np.where(own == block, next_ordinal, 0)
        block, next_ordinal = int(own[-1]), int(inside[-1]) + 1
        arrays = [who.combine_chunks().take(pa.array(first)), pa.array((own << 33) + inside)]
        for k, n in enumerate(names):
            cells = np.flatnonzero(at == k)
            raw = t.column(3).combine_chunks().take(pa.array(cells))
            values = pc.equal(raw, "true") if kinds[n] == "boolean" else raw.cast(ARROW[kinds[n]])
            place = np.full(len(first), -1, np.int64)
            place[row[cells]] = np.arange(len(cells))
            arrays.append(values.take(pa.array(place, mask=place < 0)))
        again = [[] for _ in first]
        for i in np.flatnonzero(more):
            again[row[i]].append(names[at[i]])
        arrays.append(pa.array(again, pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    waiting: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if waiting is None else pa.concat_tables([waiting, t])
        key = (t.column(0)[-1], t.column(1)[-1])
        same = np.flatnonzero((t.column(0).to_numpy() == key[0].as_py()) & pc.equal(t.column(1), key[1]).to_numpy(zero_copy_only=False))
        if same[0]:
            yield wide(t.slice(0, same[0]))
        waiting = t.slice(same[0])
    if waiting is not None:
        yield wide(waiting)


def distinct_cells(cells: DataFrame) -> DataFrame:
    """Typed cells with each different value of an entity and attribute once, written to the shared folder: parsed once."""
    return materialise(cells.groupBy("entity", "parameter", "cell").agg(F.first("value_type").alias("value_type"), F.min("raw").alias("raw")), "cells")


def widen(cells: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(wide, others) of distinct_cells. kinds: the attributes that become columns and their types.

    wide: entity, ordinal (global: the range number times 2^33 plus the position in it), one typed column per attribute
    (name plus '_value' where it would clash with the rest) and more, the attributes of which others has further values; an
    entity without a fitting value has no row. Of values that disagree it holds the least, numbers by size, the rest by text.
    others: entity, parameter, cell of the rest, nothing is dropped.
    """
    spark = cells.sparkSession
    names = list(kinds)
    out = {n: n + "_value" if n.lower() in ("entity", "ordinal", "more") else n for n in names}
    schema = pa.schema([("entity", pa.string()), ("ordinal", pa.int64()), *[(out[n], ARROW[kinds[n]]) for n in names], ("more", pa.list_(pa.string()))])
    ddl = ", ".join(["entity string", "ordinal bigint", *[f"`{out[n]}` {TYPES[kinds[n]]}" for n in names], "more array<string>"])
    if not names:
        return spark.createDataFrame([], ddl), cells.select("entity", "parameter", "cell").limit(0)
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells.count() // BLOCK_ROWS))
    size = F.when(F.col("value_type").isin("integer", "double"), F.col("raw").try_cast("double"))
    least = cells.groupBy("entity", "parameter").agg(F.min(F.struct(size.alias("size"), "cell", "raw")).alias("_min"), (F.count("*") > 1).alias("_more"))
    block = F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int").alias("_block")
    at = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("parameter")) - 1).cast("int").alias("_at")
    spread = least.select(block, "entity", at, F.col("_min.raw").alias("raw"), "_more").where("_at >= 0").repartition(blocks, "_block").sortWithinPartitions("_block", "entity")
    wide = spread.mapInArrow(lambda it: _assemble(it, names, kinds, schema), ddl)
    split = least.where("_more").select("entity", "parameter", F.col("_min.cell").alias("_first"))
    others = cells.join(split, ["entity", "parameter"]).where(F.col("cell") != F.col("_first")).select("entity", "parameter", "cell")
    return wide, others


def narrow(wide: DataFrame, others: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(entity, parameter, cell): the wide table and the values beside it back in one long table, losing nothing."""
    names = {n: n + "_value" if n.lower() in ("entity", "ordinal", "more") else n for n in kinds}
    pairs = [F.struct(F.lit(n).alias("parameter"), cell(F.col(f"`{c}`"), kinds[n]).alias("cell")) for n, c in names.items()]
    if not pairs:
        return others
    long = wide.select("entity", F.explode(F.filter(F.array(*pairs), lambda p: p["cell"].isNotNull())).alias("p")).select("entity", "p.*")
    return reduce(DataFrame.unionByName, [long, others.select("entity", "parameter", "cell")])
