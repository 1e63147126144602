"""Items of varying size into containers of fixed capacity.

Method: first-fit decreasing with a tournament tree of the room left in each container, run independently in randomised
groups of items. The groups are drawn by a hash of the item, so each has the size distribution of the whole and the loss
at its last containers is about one container a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items packed together; one group is one piece of work of a task.
GROUP_ITEMS = 20_000
GROUP_SEED = 17


class Tournament:
    """Leaves: the room left in each container; every node holds the most room below it. Containers open on demand."""

    def __init__(self, capacity: int, leaves: int):
        self.capacity, self.size = capacity, 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.tree = [capacity] * (2 * self.size)

    def put(self, item: int) -> int:
        """The first container with room for item, which loses that room."""
        tree, at = self.tree, 1
        while at < self.size:
            at *= 2
            if tree[at] < item:
                at += 1
        where = at - self.size
        tree[at] -= item
        at //= 2
        while at:
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
            at //= 2
        return where


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item (sizes up to capacity), items taken by falling size, ties in the order given."""
    out = [0] * len(sizes)
    tree = Tournament(capacity, len(sizes))
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = tree.put(sizes[i])
    return out


def pack(items: DataFrame, item: str, size: str, budgets: list[tuple[int, int]], total: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(budget_id, container_id, item, piece_no, piece_from, n_tokens): where every item goes, for every budget.

    budgets: (budget_id, capacity); capacities that are null or below 1 are left out. total: about how many items there
    are (it sets the number of groups). An item above the capacity is cut into full pieces, each filling a container of
    its own, and a rest that is packed like any item; no other item is cut. Items of size 0 or null take part with size
    0. container_id is unique within a budget: group number times 2^32 plus the container's number in its group, full
    pieces after the packed ones. Repeated items are packed once per row.
    """
    budgets = [(int(b), int(c)) for b, c in budgets if b is not None and c is not None and c >= 1]
    groups = max(1, -(-total // group_items))
    schema = f"budget_id int, container_id bigint, `{item}` bigint, piece_no int, piece_from bigint, n_tokens bigint"
    if not budgets:
        return items.sparkSession.createDataFrame([], schema)
    work = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("capacity")) for b, c in budgets])).alias("b")
    rows = items.select(F.pmod(F.xxhash64(F.col(item), F.lit(GROUP_SEED)), F.lit(groups)).alias("_group"), work, F.col(item).cast("bigint").alias(item), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size"))
    rows = rows.select("_group", "b.*", item, "_size").repartition("_group", "budget_id").sortWithinPartitions("_group", "budget_id", item, "_size")

    def close(key: tuple, ids: list[int], sizes: list[int], out: list[list]) -> None:
        group, budget, capacity = key
        base = group << 32
        rest = [s % capacity if s > capacity else s for s in sizes]
        whole = [s // capacity if s > capacity else 0 for s in sizes]
        packed = [i for i in range(len(ids)) if not (whole[i] and rest[i] == 0)]
        where = dict(zip(packed, first_fit_decreasing([rest[i] for i in packed], capacity)))
        fresh = max(where.values(), default=-1) + 1
        for i, doc in enumerate(ids):
            for k in range(whole[i]):
                for column, v in zip(out, (budget, base + fresh, doc, k, k * capacity, capacity)):
                    column.append(v)
                fresh += 1
            if i in where:
                for column, v in zip(out, (budget, base + where[i], doc, whole[i], whole[i] * capacity, rest[i])):
                    column.append(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = ["budget_id", "container_id", item, "piece_no", "piece_from", "n_tokens"]
        at, ids, sizes = None, [], []

        def packed() -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], [], []]
            close(at, ids, sizes, out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

        for b in batches:
            for g, budget, capacity, doc, s in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (g, budget, capacity) != at:
                    if at is not None:
                        yield packed()
                    at, ids, sizes = (g, budget, capacity), [], []
                ids.append(doc), sizes.append(s)
        if at is not None:
            yield packed()

    return rows.mapInArrow(run, schema)


def usage(packed: DataFrame, budgets: list[tuple[int, int]]) -> DataFrame:
    """(budget_id, capacity_tokens, n_containers, least_containers, fullest, unused_share) of the containers of pack().

    least_containers: the total by the capacity, rounded up, which no packing can do with fewer. unused_share: the space that
    stays empty by that of all containers. Sums per container are taken on the map side first; budgets without items have
    no row.
    """
    limits = F.create_map(*[F.lit(x) for b, c in budgets if b is not None and c is not None and c >= 1 for x in (int(b), int(c))])
    load = packed.groupBy("budget_id", "container_id").agg(F.sum("n_tokens").alias("_load"))
    t = load.groupBy("budget_id").agg(F.count("*").alias("n_containers"), F.sum("_load").alias("_total"), F.max("_load").alias("fullest")).withColumn("capacity_tokens", limits[F.col("budget_id")].cast("bigint"))
    space = F.col("capacity_tokens") * F.col("n_containers")
    return t.select("budget_id", "capacity_tokens", "n_containers", F.ceil(F.col("_total") / F.col("capacity_tokens")).alias("least_containers"), "fullest", (1 - F.col("_total") / space).alias("unused_share"))
