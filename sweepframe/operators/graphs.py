"""Graphs as edge tables: degrees, directions, complements, components, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import previous, running_sum


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): edges (src, dst) counted at both ends, each undirected edge once; a loop counts twice."""
    e = edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def mutual(edges: DataFrame, rate: float = 1.0) -> DataFrame:
    """(src, dst, transmit): every undirected edge in both directions with a rate."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src is not null and dst is not null and src <> dst").distinct().withColumn("transmit", F.lit(rate))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component): the least node of each connected component, by alternating large-star and small-star rounds.

    Every round is two groupings over at most the number of edges, written to the shared folder; the number of rounds
    grows with the logarithm of the graph's size. A hub of any degree is an ordinary group: only its minimum is taken,
    by an aggregate that combines on the map side, and joined back.
    """
    e = materialise(edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct(), "components")
    nodes = e.select(F.explode(F.array("lo", "hi")).alias("node")).distinct()
    e = materialise(e.where("lo <> hi"), "components")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        j = pairs.join(least, "u")
        if large:
            out = j.where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        else:
            out = j.select(F.col("m").alias("lo"), F.col("v").alias("hi")).unionByName(least.select(F.col("m").alias("lo"), F.col("u").alias("hi")))
        return out.where("lo < hi").distinct()

    before = None
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        e = materialise(star(both, True), "components")
        e = materialise(star(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")), False), "components")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise ValueError("the components need more than max_rounds")
    return nodes.join(e.select(F.col("hi").alias("node"), F.col("lo").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def cluster_1d(df: DataFrame, keys: list[str], order: list[str], value: Column, cutoff: float, out: str = "cluster") -> DataFrame:
    """Add the number of the cluster in the group: neighbours at most cutoff apart are connected (a threshold graph on a line)."""
    t = df.withColumn("_x", value)
    p = previous(t, keys, order, ["_x"], "_b")
    return running_sum(p, keys, order, {out: F.when(F.col("_x") - F.col("_b._x") <= cutoff, 0).otherwise(1)}).drop("_x", "_b")


def complement_counts(edges: DataFrame) -> DataFrame:
    """(node, absent): for every node the number of nodes it has no edge to, without listing the complement's edges."""
    d = degrees(edges.where("src <> dst"))
    return d.select("node", (F.lit(d.count()) - 1 - F.col("degree")).alias("absent"))


def best_overlap(members: DataFrame, set_col: str, member: str, queries: DataFrame) -> DataFrame:
    """(query_id, id, shared, jaccard): for each query set the other set that overlaps it most, ties to the smaller id.

    members and queries: one row per set and member (a stated query set against all). Only sets that share a member meet, by
    an equi-join on it. Queries that share none with another set have no row; nulls are no members.
    """
    rows = members.where(F.col(set_col).isNotNull() & F.col(member).isNotNull()).select(F.col(set_col).alias("id"), F.col(member).alias("m")).distinct()
    asked = queries.where(F.col(set_col).isNotNull() & F.col(member).isNotNull()).select(F.col(set_col).alias("query_id"), F.col(member).alias("m")).distinct()
    shared = asked.join(rows, "m").where("query_id <> id").groupBy("query_id", "id").agg(F.count("*").alias("shared"))
    size = rows.groupBy("id").agg(F.count("*").alias("_k"))
    own = asked.groupBy("query_id").agg(F.count("*").alias("_q"))
    j = shared.join(size, "id").join(own, "query_id").withColumn("jaccard", F.col("shared") / (F.col("_k") + F.col("_q") - F.col("shared")))
    return j.groupBy("query_id").agg(F.min(F.struct((-F.col("jaccard")).alias("v"), "id", "shared", "jaccard")).alias("b")).select("query_id", "b.id", "b.shared", "b.jaccard")


def triangles(edges: DataFrame) -> DataFrame:
    """(triangles, transitivity) of the undirected graph of edges (src, dst): three times the triangles by the connected triples.

    Every edge goes from its end of lower degree to the other, so the paths of two edges that are checked start where few
    edges do: a hub starts none to smaller nodes.
    """
    e = edges.where("src is not null and dst is not null and src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    d = degrees(e)
    ranked = e.join(d.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    out = materialise(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")), "oriented")
    paths = out.alias("x").join(out.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
    n = paths.join(out, ["a", "b"]).agg(F.count("*").alias("triangles"))
    triples = d.agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("_t"))
    return n.withColumn("_j", F.lit(1)).join(triples.withColumn("_j", F.lit(1)), "_j").select("triangles", (3.0 * F.col("triangles") / F.nullif("_t", F.lit(0.0))).alias("transitivity"))
