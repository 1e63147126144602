"""Trees as node tables (tree, node, parent, length): depths, counts, balance statistics, distances, clusters, lineages through time.

All steps are joins and aggregations over the whole node table. What depends on all ancestors or descendants goes by pointer
doubling: after k rounds a node knows its 2^k-th ancestor and what lies on the way there or below it within 2^k edges, so
log2 of the height rounds are enough for ladders too. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import last_known, previous, running_sum

MAX_ROUNDS = 64
KEY = ["tree", "node"]


def _hops(nodes: DataFrame) -> DataFrame:
    """(tree, node, up, hops, dist): every node with a pointer to its parent."""
    root = F.col("parent").isNull()
    return nodes.select("tree", "node", F.col("parent").alias("up"), F.when(root, 0).otherwise(1).cast("bigint").alias("hops"), F.when(root, 0.0).otherwise(F.coalesce(F.col("length").cast("double"), F.lit(0.0))).alias("dist"))


def _jump(hop: DataFrame, on_way: dict[str, Column]) -> DataFrame:
    """Pointers of double length; on_way: columns made of those of a (the node) and b (where it points to)."""
    a, b = hop.alias("a"), hop.alias("b")
    open_ = a.where("up is not null").join(b, (F.col("a.tree") == F.col("b.tree")) & (F.col("a.up") == F.col("b.node")))
    rest = [c for c in hop.columns if c not in ("tree", "node", "up", "hops", "dist", *on_way)]
    moved = open_.select("a.tree", "a.node", "b.up", (F.col("a.hops") + F.col("b.hops")).alias("hops"), (F.col("a.dist") + F.col("b.dist")).alias("dist"), *[e.alias(n) for n, e in on_way.items()], *[F.col(f"a.{c}").alias(c) for c in rest])
    return hop.where("up is null").unionByName(moved)


def _doubled(hop: DataFrame, below: dict[str, Column] | None = None, on_way: dict[str, Column] | None = None, keep: list[DataFrame] | None = None) -> DataFrame:
    """hop with all pointers at the roots. below: columns gathered from descendants by an aggregate over the pointing nodes;
    on_way: columns gathered towards the root. keep receives the pointers of each round."""
    for _ in range(MAX_ROUNDS):
        hop = materialise(hop, "hops")
        if keep is not None:
            keep.append(hop)
        if hop.where("up is not null").isEmpty():
            return hop
        after = _jump(hop, on_way or {})
        if below:
            got = hop.where("up is not null").groupBy("tree", F.col("up").alias("node")).agg(*[e.alias(f"_{n}") for n, e in below.items()])
            # a count or a least value (near) grows by what points here from 2^k edges below
            grow = {n: F.least(n, f"_{n}") if n == "near" else F.col(n) + F.coalesce(f"_{n}", F.lit(0)) for n in below}
            after = after.join(got, KEY, "left").withColumns(grow).drop(*[f"_{n}" for n in below])
        hop = after
    raise ValueError("the parents form a cycle, or a tree is higher than 2^64")


def depths(nodes: DataFrame) -> DataFrame:
    """nodes plus depth (edges to the root) and height (sum of lengths to the root, the root's own length left out).

    Roots have a null parent. A null length counts as 0; a node whose parent is missing from its tree raises no error and
    has no row. Parents in a cycle raise.
    """
    done = _doubled(_hops(nodes))
    return nodes.join(done.select("tree", "node", F.col("hops").alias("depth"), F.col("dist").alias("height")), KEY)


def labelled(nodes: DataFrame) -> DataFrame:
    """nodes plus depth, height, children, tips (below it; a tip counts itself) and near (the distance to the nearest tip below)."""
    kids = nodes.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    hop = _hops(nodes).join(kids, KEY, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    tip = F.col("children") == 0
    hop = hop.withColumns({"tips": F.when(tip, 1).otherwise(0).cast("bigint"), "near": F.when(tip, 0.0)})
    done = _doubled(hop, {"tips": F.sum("tips"), "near": F.min(F.col("dist") + F.col("near"))})
    return nodes.join(done.select("tree", "node", F.col("hops").alias("depth"), F.col("dist").alias("height"), "children", "tips", "near"), KEY)


def subtree_tips(nodes: DataFrame) -> DataFrame:
    """(tree, node, parent, tips): the number of tips below every node (a tip counts itself)."""
    return labelled(nodes).select("tree", "node", "parent", "tips")


def balance(nodes: DataFrame) -> DataFrame:
    """(tree, ntip, sackin, cherries, colless, cophenetic, width): statistics of each tree.

    sackin: sum of the tips' depths. cherries: nodes with exactly two children, both tips. colless: sum over nodes with
    two children of the difference of their tips. cophenetic: sum over pairs of tips of the depth of their last common
    ancestor, from the counts below each inner node but the root. width: the most nodes at one depth.
    """
    d = materialise(labelled(nodes), "labelled")
    tip = F.col("children") == 0
    per_tree = d.groupBy("tree").agg(F.count_if(tip).alias("ntip"), F.sum(F.when(tip, F.col("depth")).otherwise(0)).alias("sackin"), F.sum(F.when(F.col("parent").isNotNull() & ~tip, F.col("tips") * (F.col("tips") - 1) / 2).otherwise(0)).cast("bigint").alias("cophenetic"))
    inner = _by_parent(d).groupBy("tree").agg(F.count_if((F.col("k") == 2) & (F.col("kt") == 2)).alias("cherries"), F.sum(F.when(F.col("k") == 2, F.col("hi") - F.col("lo")).otherwise(0)).alias("colless"))
    width = d.groupBy("tree", "depth").agg(F.count("*").alias("n")).groupBy("tree").agg(F.max("n").alias("width"))
    out = per_tree.join(inner, "tree", "left").join(width, "tree")
    return out.fillna(0, ["cherries", "colless"]).select("tree", "ntip", "sackin", "cherries", "colless", "cophenetic", "width")


def _by_parent(d: DataFrame) -> DataFrame:
    """(tree, node, k, kt, hi, lo): children, children that are tips, most and least tips below a child, of every inner node."""
    return d.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("k"), F.count_if(F.col("children") == 0).alias("kt"), F.max("tips").alias("hi"), F.min("tips").alias("lo"))


def shape(nodes: DataFrame) -> DataFrame:
    """(tree, il_nodes, max_ladder, max_delta_width, prop_unbalanced, mean_balance, width_depth, int_tip_ratio, gamma) of each tree.

    il_nodes: inner nodes of several children of which exactly one is a tip. max_ladder: the most of them in a row from child
    to parent. max_delta_width: the greatest change of the number of nodes from one depth to the next. prop_unbalanced and
    mean_balance: over inner nodes with two children, the share whose children have different numbers of tips and the mean of
    the smaller by the larger. width_depth: the greatest width by the greatest depth. int_tip_ratio: the mean length of inner
    branches by that of tip branches. gamma: Pybus and Harvey's statistic over the heights of inner nodes, with the lineages
    that are there between them. Null where a tree has too few nodes for one.
    """
    d = materialise(labelled(nodes), "labelled")
    pairs = materialise(d.join(_by_parent(d), KEY, "left").select(*d.columns, "k", "kt", "hi", "lo"), "labelled")
    two = F.col("k") == 2
    il = (F.col("k") > 1) & (F.col("kt") == 1)
    branch = F.when(F.col("parent").isNotNull(), F.coalesce(F.col("length").cast("double"), F.lit(0.0)))
    tip = F.col("children") == 0
    one = pairs.groupBy("tree").agg(
        F.count_if(il).alias("il_nodes"), F.avg(F.when(two, (F.col("hi") != F.col("lo")).cast("double"))).alias("prop_unbalanced"), F.avg(F.when(two, F.col("lo") / F.col("hi"))).alias("mean_balance"),
        (F.avg(F.when(~tip, branch)) / F.nullif(F.avg(F.when(tip, branch)), F.lit(0.0))).alias("int_tip_ratio"), F.max("depth").alias("_depth"), F.max("height").alias("_top"),
    )
    by_depth = d.groupBy("tree", "depth").agg(F.count("*").alias("n"))
    step = previous(by_depth, ["tree"], ["depth"], ["n"], "_b").groupBy("tree").agg(F.max("n").alias("_width"), F.max(F.abs(F.col("n") - F.col("_b.n"))).alias("max_delta_width"))
    # runs of il nodes: the pointer of one goes to its parent only if that is one too
    rungs = pairs.where(il).select("tree", "node", "parent")
    up = rungs.join(rungs.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_up")), ["tree", "parent"], "left")
    runs = _doubled(_hops(up.select("tree", "node", F.when(F.col("_up"), F.col("parent")).alias("parent"), F.lit(0.0).alias("length"))))
    ladder = runs.groupBy("tree").agg((F.max("hops") + 1).alias("max_ladder"))
    # gamma: lineages between successive inner nodes
    inner = pairs.where(~tip).select("tree", "node", "height", (F.col("k") - 1).alias("_more"))
    inner = running_sum(previous(inner, ["tree"], ["height", "node"], ["height"], "_b"), ["tree"], ["height", "node"], {"_lin": F.col("_more")})
    ends = d.groupBy("tree").agg(F.max("height").alias("height"))
    # the lineages before an inner node are 1 plus all that earlier nodes added
    area = inner.select("tree", "height", "node", ((F.col("_lin") - F.col("_more") + 1) * (F.col("height") - F.col("_b.height"))).alias("_g"), "_lin")
    run = running_sum(area.withColumn("_g", F.coalesce("_g", F.lit(0.0))), ["tree"], ["height", "node"], {"_t": F.col("_g")})
    last = run.groupBy("tree").agg(F.count("*").alias("_m"), F.max("_t").alias("_end"), F.max("_lin").alias("_l"), F.max("height").alias("_h"), F.sum("_t").alias("_s"))
    last = last.join(ends, "tree").withColumn("_T", F.col("_end") + (F.col("_l") + 1) * (F.col("height") - F.col("_h")))
    m = F.col("_m") - 1
    gamma = last.select("tree", F.when((m > 0) & (F.col("_T") > 0), (F.col("_s") / m - F.col("_T") / 2) / (F.col("_T") * F.sqrt(1 / (12 * m)))).alias("gamma"))
    out = one.join(step, "tree", "left").join(ladder, "tree", "left").join(gamma, "tree", "left").withColumn("width_depth", F.when(F.col("_depth") > 0, F.col("_width") / F.col("_depth")))
    out = out.fillna(0, ["max_ladder", "max_delta_width"])
    return out.select("tree", "il_nodes", "max_ladder", "max_delta_width", "prop_unbalanced", "mean_balance", "width_depth", "int_tip_ratio", "gamma")


def patristic(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(tree, a, b, distance) of the asked pairs (tree, a, b), by their last common ancestor.

    Pointers of all powers of two are kept; both ends are lifted to the same depth and then together, greatest jumps first,
    as long as they don't meet: two joins a power. Pairs with an unknown node have no row.
    """
    jumps: list[DataFrame] = []
    done = _doubled(_hops(nodes), keep=jumps)
    p = done.select("tree", "node", F.col("hops").alias("depth"), F.col("dist").alias("height"))
    q = queries.select("tree", "a", "b").join(p.select("tree", F.col("node").alias("a"), F.col("depth").alias("dx"), F.col("height").alias("hx")), ["tree", "a"]).join(p.select("tree", F.col("node").alias("b"), F.col("depth").alias("dy"), F.col("height").alias("hy")), ["tree", "b"])
    front = materialise(q.select("*", F.col("a").alias("x"), F.col("b").alias("y")), "pairs")

    def lift(t: DataFrame, end: str, k: int, when: Column) -> DataFrame:
        up = jumps[k].where("up is not null").select("tree", F.col("node").alias(end), F.col("up").alias(f"_u{end}"))
        return t.join(up, ["tree", end], "left").withColumn(f"_l{end}", F.when(when, F.col(f"_u{end}")))

    powers = range(len(jumps) - 2, -1, -1)
    for k in powers:  # to the same depth
        for end, d, other in (("x", "dx", "dy"), ("y", "dy", "dx")):
            far = F.col(d) - F.col(other) >= (1 << k)
            front = lift(front, end, k, far).withColumn(end, F.coalesce(f"_l{end}", end)).withColumn(d, F.when(far, F.col(d) - (1 << k)).otherwise(F.col(d))).drop(f"_u{end}", f"_l{end}")
    front = materialise(front, "pairs")
    for k in powers:  # to just below the ancestor
        t = lift(lift(front, "x", k, F.lit(True)), "y", k, F.lit(True))
        go = F.col("_lx").isNotNull() & F.col("_ly").isNotNull() & (F.col("_lx") != F.col("_ly"))
        front = t.withColumn("_go", F.coalesce(go, F.lit(False))).withColumns({"x": F.when(F.col("_go"), F.col("_lx")).otherwise(F.col("x")), "y": F.when(F.col("_go"), F.col("_ly")).otherwise(F.col("y"))}).drop("_ux", "_uy", "_lx", "_ly", "_go")
    parent = _hops(nodes).select("tree", F.col("node").alias("x"), F.col("up").alias("_p"))
    front = front.join(parent, ["tree", "x"]).withColumn("node", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("_p")))
    return front.join(p.select("tree", "node", "height"), KEY).select("tree", "a", "b", (F.col("hx") + F.col("hy") - 2 * F.col("height")).alias("distance"))


def distance_clusters(nodes: DataFrame, cutoff: float) -> DataFrame:
    """(tree, tip, cluster): the tips of each tree linked by distances along the tree of at most cutoff, directly or over other
    tips; cluster is the node at the top of theirs. Lengths must not be negative.

    No pairs: let near(v) be the distance from a node to the nearest tip anywhere. Two tips with a path through v are within
    cutoff only if both are within cutoff of the tip nearest to v, so the clusters are what is left of the tree when every
    branch is cut that no tip below it can cross and still reach, within cutoff, the tip nearest to its upper end.
    """
    d = materialise(labelled(nodes).select("tree", "node", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"), "height", "children", "near"), "labelled")
    # near anywhere: the least, over all ancestors, of the way up to it and down to its nearest tip
    hop = _hops(d).join(d.select("tree", "node", (F.col("near") - F.col("height")).alias("least")), KEY)
    any_ = _doubled(hop, on_way={"least": F.least("a.least", "b.least")}).select("tree", "node", (F.col("dist") + F.col("least")).alias("anywhere"))
    up = d.join(any_.withColumnRenamed("node", "parent"), ["tree", "parent"])
    held = up.where(F.round(F.col("near") + F.col("length") + F.col("anywhere"), 12) <= cutoff).select("tree", "node", "parent", "length")
    forest = d.select("tree", "node").join(held, KEY, "left").select("tree", "node", "parent", "length")
    keep = ["tree", "node", "top"]
    hop = _hops(forest).withColumn("top", F.coalesce("up", "node"))
    tops = _doubled(hop, on_way={"top": F.col("b.top")}).select(*keep)
    return d.where("children = 0").join(tops, KEY).select("tree", F.col("node").alias("tip"), F.col("top").alias("cluster"))


def lineages(df: DataFrame, keys: list[str], time: Column) -> DataFrame:
    """(keys, x, f): the share of lineages at each time, both scaled to [0, 1]: a step function."""
    t = df.select(*keys, time.cast("double").alias("x")).where("x is not null")
    from .weighted import distribution

    d = distribution(t, keys, "x", F.lit(1.0))
    span = d.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = d.join(span, keys).where("hi > lo")
    return j.select(*keys, ((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"), (F.col("cum") / F.col("total")).alias("f"))


def nltt_curves(nodes: DataFrame) -> DataFrame:
    """(tree, x, f): the normalised lineages through time of each tree, a step function. Inner nodes only, their heights rounded
    to 8 digits and divided by the greatest; f counts the inner nodes up to there but the first, as a share of all but the
    first. Trees with fewer than two different heights or inner nodes have no rows."""
    d = labelled(nodes).where("children > 0").select("tree", F.round("height", 8).alias("x"))
    points = d.groupBy("tree", "x").agg(F.count("*").alias("w"))
    top = points.groupBy("tree").agg(F.max("x").alias("_top"), F.sum("w").alias("_n"))
    run = running_sum(points, ["tree"], ["x"], {"cum": F.col("w")}).join(top, "tree").where("_n > 1 and _top > 0")
    return run.select("tree", (F.col("x") / F.col("_top")).alias("x"), ((F.col("cum") - 1) / (F.col("_n") - 1)).alias("f"))


def step_distance(curves: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """(key, distance): the area between each rising step function (key, x, f) and the reference one (x, f), on [0, 1].

    A function keeps the value of its last knot (0 before the first). Both rise, so on a piece of a curve the reference
    crosses it once at most: the area follows from the reference's own area up to both ends and up to the crossing. These
    are looked up, by place and by value, so the cost follows the knots of the curves, however many there are, and the
    reference is read once. A null key has no row.
    """
    ref = materialise(reference.where("x is not null and f is not null").groupBy("x").agg(F.max("f").alias("f")).withColumn("_all", F.lit(0)), "reference")
    ref = previous(ref, ["_all"], ["x"], ["x", "f"], "_b")
    ref = running_sum(ref, ["_all"], ["x"], {"area": F.coalesce((F.col("x") - F.col("_b.x")) * F.col("_b.f"), F.lit(0.0))})
    ref = materialise(ref.select("_all", "x", "f", "area"), "reference")
    own = curves.where(F.col(key).isNotNull() & F.col("x").isNotNull() & F.col("f").isNotNull()).groupBy(key, "x").agg(F.max("f").alias("f"))
    ends = own.groupBy(key).agg(F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("f"))
    starts = own.groupBy(key).agg(F.lit(0.0).alias("x"), F.lit(0.0).alias("f"))
    own = materialise(own.unionByName(ends).unionByName(starts).groupBy(key, "x").agg(F.max("f").alias("f")).withColumn("_all", F.lit(0)), "curves")
    knot = F.struct("x", "f", "area")
    empty = F.lit(None).cast("struct<x:double,f:double,area:double>")
    kind = curves.schema[key].dataType.simpleString()
    # the reference's area up to each knot of a curve
    line = ref.select("_all", "x", F.lit(0).alias("_o"), F.lit(None).cast(kind).alias(key), F.lit(None).cast("double").alias("f"), knot.alias("_at")).unionByName(own.select("_all", "x", F.lit(1).alias("_o"), key, "f", empty.alias("_at")))
    own = last_known(line, ["_all"], ["x", "_o", key], "_at", "_g").where("_o = 1")
    own = materialise(own.select("_all", key, "x", "f", F.coalesce(F.col("_g.area") + F.col("_g.f") * (F.col("x") - F.col("_g.x")), F.lit(0.0)).alias("upto")), "curves")
    # where the reference first reaches the value that begins at the knot: among values from above, the last one not below it
    none = F.lit(None).cast("double")
    line = ref.select("_all", (-F.col("f")).alias("_v"), F.lit(0).alias("_o"), (-F.col("x")).alias("_n"), F.lit(None).cast(kind).alias(key), none.alias("x"), none.alias("f"), none.alias("upto"), knot.alias("_at"))
    line = line.unionByName(own.select("_all", (-F.col("f")).alias("_v"), F.lit(1).alias("_o"), (-F.col("x")).alias("_n"), key, "x", "f", "upto", empty.alias("_at")))
    own = last_known(line, ["_all"], ["_v", "_o", "_n", key], "_at", "_c").where("_o = 1")
    own = materialise(own.select(key, "x", "f", "upto", F.col("_c.x").alias("_cx"), F.col("_c.area").alias("_ca")), "curves")
    piece = previous(own, [key], ["x"], ["x", "f", "upto", "_cx", "_ca"], "b").where("b is not null")
    b = F.col("b")
    # the reference is below the value up to the crossing t and at or above it from there on
    t = F.least(F.greatest(F.coalesce(b["_cx"], F.lit(float("inf"))), b["x"]), F.col("x"))
    at = F.when(t <= b["x"], b["upto"]).when(t >= F.col("x"), F.col("upto")).otherwise(b["_ca"])
    area = b["f"] * (t - b["x"]) - (at - b["upto"]) + (F.col("upto") - at) - b["f"] * (F.col("x") - t)
    return piece.groupBy(key).agg(F.sum(area).alias("distance"))


def scale_branches(nodes: DataFrame) -> DataFrame:
    """nodes with lengths divided by their tree's mean length (roots and null lengths aside); unchanged where the mean is 0."""
    mean = nodes.where("parent is not null").groupBy("tree").agg(F.avg("length").alias("_m"))
    j = nodes.join(mean, "tree", "left")
    return j.withColumn("length", F.when(F.col("_m") != 0, F.col("length") / F.col("_m")).otherwise(F.col("length"))).select(*nodes.columns)


def ladderize(nodes: DataFrame) -> DataFrame:
    """nodes plus child_pos: siblings by the tips below them, fewest first, ties by branch length, then by name."""
    tips = subtree_tips(nodes).select("tree", "node", "tips")
    w = Window.partitionBy("tree", "parent").orderBy("tips", F.col("length").asc_nulls_first(), "node")  # the children of one node
    return nodes.join(tips, KEY).withColumn("child_pos", F.row_number().over(w)).drop("tips")


def prune(nodes: DataFrame, drop: DataFrame) -> DataFrame:
    """The trees without the tips in drop (tree, node): inner nodes left without children go, those with one child are
    contracted, their lengths added; a root with one child gives way to it. A tree without tips left has no rows."""
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("length").cast("double"), F.lit(0.0)).alias("length"))
    inner = base.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    tips = base.join(inner, KEY, "left_anti").join(drop.select("tree", "node").distinct(), KEY, "left_anti").select("tree", "node", F.lit(1).alias("_tip"))
    hop = _hops(base).join(tips, KEY, "left").select("tree", "node", "up", "hops", "dist", F.coalesce("_tip", F.lit(0)).cast("bigint").alias("tips"))
    left = materialise(base.join(_doubled(hop, {"tips": F.sum("tips")}).where("tips > 0").select(*KEY), KEY), "prune")
    single = left.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("_k")).where("_k = 1").select("tree", "node", F.lit(True).alias("_single"))
    # pointers run through nodes with one child only; they stop at the first node that stays, or above the root
    marked = left.join(single, KEY, "left").withColumn("_single", F.coalesce("_single", F.lit(False)))
    hop = marked.select("tree", "node", F.col("parent").alias("to"), "length", "_single")
    for _ in range(MAX_ROUNDS):
        hop = materialise(hop, "prune")
        through = hop.where("_single").select("tree", F.col("node").alias("to"), F.col("to").alias("_to"), F.col("length").alias("_more"), F.lit(True).alias("_go"))
        step = hop.join(through, ["tree", "to"], "left")
        if step.where("_go").isEmpty():
            break
        go = F.col("_go").isNotNull()
        hop = step.select("tree", "node", F.when(go, F.col("_to")).otherwise(F.col("to")).alias("to"), F.when(go, F.col("length") + F.col("_more")).otherwise(F.col("length")).alias("length"), "_single")
    else:
        raise ValueError("the parents form a cycle, or a chain is longer than 2^64")
    out = hop.where("not _single").join(left.select("tree", "node", "parent", F.col("length").alias("_own")), KEY)
    # a node that has become the root has no branch; a root that was one keeps its own length
    length = F.when(F.col("to").isNotNull(), F.col("length")).when(F.col("parent").isNull(), F.col("_own")).otherwise(0.0)
    return out.select("tree", "node", F.col("to").alias("parent"), length.alias("length"))
