"""The artifact catalogue: attribute lookup, upserts, staleness, cascading deletes, set reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def find_all(data: DataFrame, step: str, wanted: dict[str, str]) -> DataFrame:
    """Paths of the step that have every wanted (parameter, value); paths with further parameters count too."""
    match = F.lit(False)
    for k, v in wanted.items():
        match = match | ((F.col("parameter") == k) & (F.col("value") == v))
    rows = data.where((F.col("step") == step) & match & F.col("path").isNotNull())
    return rows.groupBy("path").agg(F.count_distinct("parameter").alias("_n")).where(F.col("_n") == len(wanted)).select("path")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The union with one row per key, of the greatest version (ties: the greatest other columns). Aggregated, not sorted."""
    rest = [c for c in old.columns if c not in (*key, version)]
    best = old.unionByName(new).groupBy(*key).agg(F.max(F.struct(version, *rest)).alias("_b"))
    return best.select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in old.columns])


def stale(md5: DataFrame, dependencies: DataFrame, step: Column) -> DataFrame:
    """(path, n_deps, n_stale, runnable): targets with dependencies whose stored checksum is missing or differs from the recorded
    one. runnable: of every step (an expression over dep_path) that the target depends on, at least one file has a checksum."""
    links = dependencies.where("path is not null and dep_path is not null").select("path", "dep_path", "dep_checksum").distinct()
    joined = links.join(md5.where("path is not null").select(F.col("path").alias("dep_path"), "checksum"), "dep_path", "left")
    bad = F.col("checksum").isNull() | F.col("dep_checksum").isNull() | (F.col("checksum") != F.col("dep_checksum"))
    steps = joined.groupBy("path", step.alias("_step")).agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"), F.count("checksum").alias("_files"))
    return steps.groupBy("path").agg(F.sum("_n").alias("n_deps"), F.sum("_bad").alias("n_stale"), (F.min("_files") > 0).alias("runnable")).where("n_stale > 0")


def with_checksums(dependencies: DataFrame, md5: DataFrame, stored: str) -> DataFrame:
    """(path, dep_path, checksum): every link once, with the dependency's newest checksum looked up (null if it has none).
    Of equally new checksums the greatest counts."""
    newest = md5.where("path is not null").groupBy(F.col("path").alias("dep_path")).agg(F.max(F.struct(stored, "checksum")).alias("_b"))
    links = dependencies.where("path is not null and dep_path is not null").select("path", "dep_path").distinct()
    return links.join(newest, "dep_path", "left").select("path", "dep_path", F.col("_b.checksum").alias("checksum"))


def delete_files(table: DataFrame, doomed: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of table none of whose columns names a file of doomed (path). Rows with a null there stay."""
    for c in columns:
        table = table.join(doomed.where("path is not null").select(F.col("path").alias(c)).distinct(), c, "left_anti").select(*table.columns)
    return table


def grid_mismatches(points: DataFrame) -> DataFrame:
    """(step, path, n_missing, n_extra) of the paths whose parameters are not those of their step's grid.

    points: (step, path, parameter). The keys of a step are the parameter set that most of its paths have, ties to the least
    set by text. A path holds few parameters; sets are counted, not paired.
    """
    sets = points.where("step is not null and path is not null and parameter is not null").groupBy("step", "path").agg(F.array_sort(F.collect_set("parameter")).alias("own"))
    counted = sets.groupBy("step", "own").agg(F.count("*").alias("n"))
    keys = counted.groupBy("step").agg(F.min(F.struct((-F.col("n")).alias("n"), "own")).alias("k")).select("step", F.col("k.own").alias("keys"))
    j = sets.join(keys, "step").where("own <> keys")
    return j.select("step", "path", F.size(F.array_except("keys", "own")).alias("n_missing"), F.size(F.array_except("own", "keys")).alias("n_extra"))


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(node, depth): all nodes reachable from seeds (column node, depth 0) along edges (src, dst), with the least depth; raises if
    max_rounds end before a round finds nothing new.

    Breadth first: one join a round, only with the newest nodes; each round is written to the shared folder, which cuts
    the lineage and survives lost executors. Cycles and diamonds are visited once.
    """
    edges = edges.where("src is not null and dst is not null").distinct()
    seen = materialise(seeds.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "closure")
    front = seen
    for depth in range(1, max_rounds + 1):
        step = front.select("node").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = materialise(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
    raise ValueError("the closure is deeper than max_rounds")


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """(node, level): longest distance from a source of an acyclic graph (node; src, dst); raises on a cycle.

    Each round settles the nodes all of whose predecessors are settled.
    """
    nodes, edges = nodes.select("node").distinct(), edges.distinct()
    done = materialise(nodes.join(edges, F.col("node") == F.col("dst"), "left_anti").withColumn("level", F.lit(0)), "levels")
    total, settled = nodes.count(), done.count()
    for level in range(1, max_rounds + 1):
        if settled == total:
            return done
        open_edges = edges.join(done.select(F.col("node").alias("src"), F.lit(1).alias("_d")), "src", "left")
        ready = open_edges.groupBy(F.col("dst").alias("node")).agg(F.min(F.coalesce("_d", F.lit(0))).alias("_ok")).where("_ok = 1").select("node")
        fresh = materialise(ready.join(done, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        n = fresh.count()
        if n == 0:
            raise ValueError("the graph has a cycle")
        done, settled = done.unionByName(fresh), settled + n
    raise ValueError("more levels than max_rounds")


def canonical_point(cells: DataFrame) -> DataFrame:
    """(path, name) of the cells (path, parameter, cell): md5 of the lines 'parameter=cell' in order, so the name is the same
    in whatever order and notation a point was written; contradicting cells are all in it."""
    line = F.concat_ws("=", "parameter", "cell")
    return cells.groupBy("path").agg(F.md5(F.array_join(F.array_sort(F.collect_set(line)), "\n")).alias("name"))


def round_robin(df: DataFrame, order: list[str], processes: int) -> DataFrame:
    """Add process: tasks dealt out in turn by order, without sorting them into one task (ranks by chunk offsets)."""
    from .ordered import running_sum

    ranked = running_sum(df.withColumn("_all", F.lit(0)), ["_all"], order, {"_rank": F.lit(1)})
    return ranked.withColumn("process", ((F.col("_rank") - 1) % processes).cast("int")).drop("_all", "_rank")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def verify_checksums(files: DataFrame, md5: DataFrame) -> DataFrame:
    """(path, state) of files (path, content) against md5 (path, checksum): changed, or unregistered where there is no row."""
    real = files.select("path", F.md5("content").alias("_now"))
    joined = real.join(md5.groupBy("path").agg(F.max("checksum").alias("checksum"), F.count("*").alias("_n")), "path", "left")
    state = F.when(F.col("_n").isNull(), "unregistered").when(F.col("checksum").isNull() | (F.col("checksum") != F.col("_now")), "changed")
    return joined.select("path", state.alias("state")).where("state is not null")


def varying_columns(df: DataFrame) -> list[str]:
    """Columns with more than one value (null counts as one), in one pass."""
    first = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if (first[i] or 0) > 1]
