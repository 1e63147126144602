"""Weighted posterior summaries: means, ECDF, highest-density intervals, quantiles, kernel densities.

Samples are first reduced to one row per distinct value (map-side aggregation), and all ordered steps run on that table
with the chunked windows of ordered.py, so a group may hold any share of the samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .ordered import last_known, previous, running_sum


def latest(df: DataFrame, keys: list[str], iteration: str) -> DataFrame:
    """Rows of each group's last iteration, by a join with one row per group (no group is sorted)."""
    top = df.groupBy(*keys).agg(F.max(iteration).alias("_top"))
    joined = df.alias("a").join(top.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col(f"a.{iteration}") == F.col("b._top")])
    return joined.select("a.*")


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of weight times value over the sum of weights, of rows where both are known."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(both, F.col(value) * F.col(weight))) / F.sum(F.when(both, F.col(weight)))


def distribution(df: DataFrame, keys: list[str], value: str, weight: str | Column) -> DataFrame:
    """(keys, x, w, cum, total): distinct values with their weight, running weight and the group's total."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    points = df.select(*keys, F.col(value).cast("double").alias("x"), weight.cast("double").alias("w")).where("x is not null and w is not null and w > 0")
    points = materialise(points.groupBy(*keys, "x").agg(F.sum("w").alias("w")), "distribution")  # the input is read once
    totals = points.groupBy(*keys).agg(F.sum("w").alias("total"))
    run = running_sum(points, keys, ["x"], {"cum": F.col("w")})
    return run.alias("p").join(F.broadcast(totals).alias("t") if totals.limit(10_001).count() <= 10_000 else totals.alias("t"), [F.col(f"p.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]).select("p.*", "t.total")


def ecdf(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, x, f): the weighted empirical distribution function at each distinct value."""
    return distribution(df, keys, value, weight).select(*keys, "x", (F.col("cum") / F.col("total")).alias("f"))


def hpd(df: DataFrame, keys: list[str], value: str, weight: str, conf: float) -> DataFrame:
    """(keys, lower, upper): the shortest interval holding conf of a continuous weighted sample.

    The distribution function runs linearly from 0 at the least value to 1 at the greatest. The width of the interval that
    starts at probability p is piecewise linear in p, so its minimum is at a knot or conf before one: these are the
    candidates. Ties go to the smallest start. A group with one distinct value gives that value twice.
    """
    d = materialise(distribution(df, keys, value, weight), "knots")
    low = d.groupBy(*keys).agg(F.min("x").alias("_lo"))
    d = d.alias("d").join(low.alias("l"), [F.col(f"d.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]).select("d.*", F.when(F.col("x") == F.col("_lo"), 0.0).otherwise(F.col("cum") / F.col("total")).alias("f"))
    d = materialise(d, "knots")
    ahead = previous(d.withColumn("_neg", -F.col("x")).select(*keys, "x", "f", "_neg"), keys, ["_neg"], ["x", "f"], "_next")
    knots = materialise(ahead.select(*keys, F.col("f").alias("p"), F.struct("x", "f", F.col("_next.x").alias("nx"), F.col("_next.f").alias("nf")).alias("knot")), "knots")

    ends = F.lit(1.0 - conf)
    starts = F.array_distinct(F.array(F.col("p"), F.col("p") - conf, F.when(F.col("knot.nx").isNull(), ends)))
    cand = knots.select(*keys, F.explode(F.array_compact(starts)).alias("s")).where((F.col("s") >= 0) & (F.col("s") <= 1.0 - conf)).distinct()
    probes = cand.select(*keys, "s", F.explode(F.array(F.struct(F.col("s").alias("p"), F.lit("lower").alias("side")), F.struct((F.col("s") + conf).alias("p"), F.lit("upper").alias("side")))).alias("e")).select(*keys, "s", "e.p", "e.side")
    none = [F.lit(None).cast("double").alias("s"), F.lit(None).cast("string").alias("side")]
    line = knots.select(*keys, "p", "knot", F.lit(0).alias("_o"), *none).unionByName(probes.select(*keys, "p", F.lit(None).cast(knots.schema["knot"].dataType).alias("knot"), F.lit(1).alias("_o"), "s", "side"))
    line = last_known(line, keys, ["p", "_o", "s", "side"], "knot", "_at").where("_o = 1")
    at = F.col("_at")
    x = F.when(at["nx"].isNull() | (at["nf"] == at["f"]), at["x"]).otherwise(at["x"] + (at["nx"] - at["x"]) * (F.col("p") - at["f"]) / (at["nf"] - at["f"]))
    pairs = line.withColumn("_x", x).groupBy(*keys, "s").agg(F.max(F.when(F.col("side") == "lower", F.col("_x"))).alias("lower"), F.max(F.when(F.col("side") == "upper", F.col("_x"))).alias("upper"))
    best = pairs.groupBy(*keys).agg(F.min(F.struct(F.round(F.col("upper") - F.col("lower"), 12).alias("width"), "s", "lower", "upper")).alias("b"))
    return best.select(*keys, "b.lower", "b.upper")


def hpd_discrete(df: DataFrame, keys: list[str], value: str, weight: str, conf: float) -> DataFrame:
    """(keys, lower, upper): the narrowest run of integers holding at least conf of the weight.

    Among equally narrow runs those that contain the mode are preferred, then the lowest density, then the smallest start.
    For each start the first sufficient end follows from the running weights, so runs are found by an as-of lookup and
    not by pairing all values.
    """
    d = distribution(df, keys, value, weight).withColumn("f", F.round(F.col("cum") / F.col("total"), 12)).withColumn("g", F.round((F.col("cum") - F.col("w")) / F.col("total"), 12))
    d = materialise(d, "knots")
    mode = d.groupBy(*keys).agg(F.max_by("x", F.struct("w", -F.col("x"))).alias("_mode"))
    # the first end with f >= g + conf: walking down by f, the last end at or after the wanted mass
    ends = d.select(*keys, (-F.col("f")).alias("p"), F.lit(0).alias("_o"), F.struct("x", "f").alias("end"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("g"))
    starts = d.select(*keys, (-F.round(F.col("g") + conf, 12)).alias("p"), F.lit(1).alias("_o"), F.lit(None).cast("struct<x:double,f:double>").alias("end"), "x", "g").where("p >= -1")
    runs = last_known(ends.unionByName(starts), keys, ["p", "_o", "x"], "end", "_end").where("_o = 1 and _end is not null")
    runs = runs.select(*keys, F.col("x").alias("lower"), F.col("_end.x").alias("upper"), F.round(F.col("_end.f") - F.col("g"), 9).alias("density"))
    runs = runs.alias("r").join(mode.alias("m"), [F.col(f"r.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]).select("r.*", F.when(F.col("_mode").between(F.col("lower"), F.col("upper")), 0).otherwise(1).alias("off"))
    best = runs.groupBy(*keys).agg(F.min(F.struct((F.col("upper") - F.col("lower")).alias("width"), "off", "density", "lower", "upper")).alias("b"))
    return best.select(*keys, "b.lower", "b.upper")


def hpd_ordered(df: DataFrame, keys: list[str], value: str, conf: float) -> DataFrame:
    """(keys, lower, upper): the shortest span of ceil(conf * n) - 1 steps between order statistics of an unweighted sample.

    The k-th value after each is found by its rank: ranks are running counts, the partner an equi-join on rank.
    """
    one = running_sum(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), F.monotonically_increasing_id().alias("_id")), keys, ["x", "_id"], {"r": F.lit(1)})
    n = one.groupBy(*keys).agg(F.max("r").alias("n"))
    ranked = one.groupBy(*keys, "r").agg(F.max("x").alias("x"))
    low = ranked.alias("a").join(n.alias("n"), [F.col(f"a.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]).select("a.*", (F.col("a.r") + F.greatest(F.lit(1), F.ceil(F.col("n.n") * conf)) - 1).alias("q"))
    pair = low.alias("a").join(ranked.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] + [F.col("a.q") == F.col("b.r")])
    best = pair.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.struct(F.round(F.col("b.x") - F.col("a.x"), 9).alias("width"), F.col("a.x").alias("lower"), F.col("b.x").alias("upper")).alias("s")).groupBy(*keys).agg(F.min("s").alias("b"))
    return best.select(*keys, "b.lower", "b.upper")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, q0, q1, ..., n): exact type-7 quantiles, by running counts over distinct values: no group sits in one buffer."""
    d = distribution(df, keys, value, F.lit(1.0))
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("total") - 1) * p
        picks += [F.min(F.when(F.col("cum") >= F.floor(h) + 1, F.col("x"))).alias(f"_a{i}"), F.min(F.when(F.col("cum") >= F.ceil(h) + 1, F.col("x"))).alias(f"_b{i}")]
    got = d.groupBy(*keys).agg(F.max("total").alias("_t"), *picks)
    part = lambda p: (F.col("_t") - 1) * p - F.floor((F.col("_t") - 1) * p)
    return got.select(*keys, *[(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * part(p)).alias(f"q{i}") for i, p in enumerate(probs)], F.col("_t").cast("bigint").alias("n"))


def kde(df: DataFrame, keys: list[str], value: str, weight: Column, bandwidth: float, grid: list[float]) -> DataFrame:
    """(keys, x, density) on a fixed grid: Gaussian kernel density; samples meet the bounded grid by explode and are summed on the map side."""
    points = distribution(df, keys, value, weight)
    at = points.select(*keys, "w", "total", F.col("x").alias("_s"), F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("x"))
    z = (F.col("x") - F.col("_s")) / bandwidth
    term = F.col("w") / F.col("total") * F.exp(-z * z / 2) / (bandwidth * math.sqrt(2 * math.pi))
    return at.groupBy(*keys, "x").agg(F.sum(term).alias("density"))


def arg_max(df: DataFrame, keys: list[str], score: Column, pick: list[str]) -> DataFrame:
    """(keys, pick) of the row with the greatest score, ties to the smallest pick; aggregated, not sorted."""
    best = df.groupBy(*keys).agg(F.min(F.struct((-score).alias("_s"), *pick)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{p}").alias(p) for p in pick])


def systematic_resample(df: DataFrame, keys: list[str], order: str, weight: str, draws: int) -> DataFrame:
    """(keys, order, copies): how often each row is drawn by systematic resampling of `draws` per group.

    Row i is drawn once per whole number in (C[i-1] n / W, C[i] n / W] with running weights C: a running sum, no pairing.
    """
    run = running_sum(df.where(F.col(weight) > 0).select(*keys, order, F.col(weight).alias("_w")), keys, [order], {"_c": F.col("_w")})
    total = run.groupBy(*keys).agg(F.max("_c").alias("_t"))
    j = run.alias("r").join(total.alias("t"), [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    scaled = lambda c: F.floor(F.round(c / F.col("t._t") * draws, 6))
    return j.select("r.*", (scaled(F.col("r._c")) - scaled(F.col("r._c") - F.col("r._w"))).cast("bigint").alias("copies")).select(*keys, order, "copies")


def ess(weight: str) -> Column:
    """Effective sample size of weights."""
    return F.pow(F.sum(weight), 2) / F.sum(F.col(weight) * F.col(weight))


def next_tolerance(df: DataFrame, keys: list[str], distance: str, weight: str, alpha: float) -> DataFrame:
    """(keys, epsilon, ess): the least tolerance that keeps the effective sample size at alpha times its present value.

    The sample size within a tolerance follows from running sums of weights and squared weights over distinct distances,
    so the tolerance is found in one pass and not by bisection.
    """
    p = df.where(F.col(distance).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(distance).cast("double").alias("x")).agg(F.sum(weight).alias("_w"), F.sum(F.col(weight) * F.col(weight)).alias("_q"))
    run = running_sum(p, keys, ["x"], {"_cw": F.col("_w"), "_cq": F.col("_q")})
    full = p.groupBy(*keys).agg((F.pow(F.sum("_w"), 2) / F.sum("_q")).alias("_full"))
    j = run.join(full, keys).withColumn("ess", F.pow("_cw", 2) / F.col("_cq")).where(F.col("ess") >= alpha * F.col("_full"))
    return j.groupBy(*keys).agg(F.min(F.struct("x", "ess")).alias("b")).select(*keys, F.col("b.x").alias("epsilon"), F.col("b.ess").alias("ess"))
