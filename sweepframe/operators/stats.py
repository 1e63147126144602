"""Rank and moment statistics with their p-values, fold-wise linear models, and tail fits. Ranks come from counts of
distinct values, so ties cost nothing and no group is sorted in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_max, running_sum
from .weighted import distribution


def _on(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Add the rank of value within keys, ties sharing their mean rank; null values get null."""
    d = distribution(df, keys, value, F.lit(1.0)).select(*keys, "x", (F.col("cum") - (F.col("w") - 1) / 2).alias(out))
    return df.alias("a").join(d.alias("b"), [*_on("a", "b", keys), F.col(f"a.{value}").cast("double") == F.col("b.x")], "left").select("a.*", f"b.{out}")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, rho) of rows where both are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    return average_ranks(average_ranks(both, keys, x, "_rx"), keys, y, "_ry").groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def rank_sum(df: DataFrame, value: str, second: Column) -> DataFrame:
    """(n1, n2, w, z): Wilcoxon rank-sum of the group where second is false against the other, tie-corrected normal score."""
    d = distribution(df.withColumn("_all", F.lit(0)), ["_all"], value, F.lit(1.0)).select("x", "w", (F.col("cum") - (F.col("w") - 1) / 2).alias("r"))
    n1 = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(~second).alias("n1"))
    s = d.join(n1, "x").agg(F.sum("n1").alias("n1"), F.sum("w").alias("n"), F.sum(F.col("r") * F.col("n1")).alias("rs"), F.sum(F.pow("w", 3) - F.col("w")).alias("ties"))
    n1c, n, n2 = F.col("n1"), F.col("n"), F.col("n") - F.col("n1")
    w = F.col("rs") - n1c * (n1c + 1) / 2
    var = n1c * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    dev = w - n1c * n2 / 2
    return s.select(n1c.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"), w.alias("w"), ((dev - F.signum(dev) * 0.5) / F.sqrt(var)).alias("z"))


def anova(df: DataFrame, factor: str, value: str) -> DataFrame:
    """(k, n, ss_between, ss_within, f): one-way analysis of variance from group moments."""
    g = df.where(F.col(value).isNotNull() & F.col(factor).isNotNull()).groupBy(factor).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ss").alias("ss_within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), 2) / F.sum("n")).alias("ss_between"))
    return t.select("k", "n", "ss_between", "ss_within", (F.col("ss_between") / (F.col("k") - 1) / (F.col("ss_within") / (F.col("n") - F.col("k")))).alias("f"))


def holm(df: DataFrame, p: str, order: list[str], n: int | None = None) -> DataFrame:
    """Add p_holm: step-down adjusted p-values of one family (n tests; the number of rows by default)."""
    total = n or df.count()
    ranked = running_sum(df.withColumn("_all", F.lit(0)), ["_all"], [p, *order], {"_r": F.lit(1)})
    top = running_max(ranked, ["_all"], [p, *order], {"_m": F.col(p) * (total - F.col("_r") + 1)})
    return top.withColumn("p_holm", F.least(F.lit(1.0), F.col("_m"))).drop("_all", "_r", "_m")


def linear_cv(df: DataFrame, x: str, y: str, fold: Column, replicate: Column) -> DataFrame:
    """(replicate, slope, intercept, rsquared): a line fitted on fold 0, its squared correlation on fold 1. Failures are 0."""
    t = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), fold.alias("fold"), replicate.alias("replicate")).where("x is not null and y is not null")
    fit = t.where("fold = 0").groupBy("replicate").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    test = t.where("fold = 1").groupBy("replicate").agg(F.corr("x", "y").alias("r"))
    return fit.join(test, "replicate", "left").select("replicate", "slope", "intercept", F.coalesce(F.pow("r", 2), F.lit(0.0)).alias("rsquared"))


def ks_cvm(df: DataFrame, value: str, second: Column) -> DataFrame:
    """(ks, cvm): greatest distance and mean squared distance between the distribution functions of two groups."""
    t = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b")).withColumn("_all", F.lit(0))
    n = t.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")).first()
    na, nb = n.na or 1, n.nb or 1
    r = running_sum(t, ["_all"], ["x"], {"ca": F.col("a"), "cb": F.col("b")})
    diff = F.col("ca") / na - F.col("cb") / nb
    return r.agg(F.max(F.abs(diff)).alias("ks"), (F.sum(diff * diff * (F.col("a") + F.col("b"))) / (na + nb)).alias("cvm"))


def power_law(df: DataFrame, degree: str, xmin: int = 1) -> DataFrame:
    """(n, gamma): continuous maximum-likelihood exponent of the degrees from xmin on."""
    t = df.where(F.col(degree) >= xmin)
    return t.agg(F.count("*").alias("n"), (1 + F.count("*") / F.sum(F.log(F.col(degree) / (xmin - 0.5)))).alias("gamma"))


def _zeta(s: float, q):
    """The Hurwitz zeta function, by 24 terms and the Euler-Maclaurin rest."""
    n = 24
    head = sum((q + k) ** -s for k in range(n))
    return head + (q + n) ** (1 - s) / (s - 1) + (q + n) ** -s / 2 + s * (q + n) ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * (q + n) ** (-s - 3) / 720


def power_law_fit(df: DataFrame, degree: str) -> DataFrame:
    """(xmin, n_tail, gamma, ks, p): the discrete power law of the tail of degrees from xmin on.

    For every xmin the exponent maximises the zeta likelihood; the xmin is the one whose fitted distribution is nearest to the
    data by Kolmogorov and Smirnov's distance ks, of which p is the asymptotic p-value. Spark counts the degrees; only the
    counts per different degree (100,000 at most, else it raises) are fitted on the driver.
    """
    import numpy as np

    counts = df.where(F.col(degree) >= 1).groupBy(F.col(degree).cast("bigint").alias("k")).agg(F.count("*").alias("n")).orderBy("k").limit(100_001).collect()
    if len(counts) > 100_000:
        raise ValueError("more than 100,000 different degrees")
    schema = "xmin bigint, n_tail bigint, gamma double, ks double, p double"
    k, n = np.array([c.k for c in counts], float), np.array([c.n for c in counts], float)
    best = None
    for i in range(max(0, len(k) - 1)):
        x, w = k[i:], n[i:]
        total, logs = w.sum(), float((w * np.log(x)).sum())
        lo, hi = 1.0001, 12.0
        loss = lambda g: total * math.log(_zeta(g, x[0])) + g * logs  # noqa: E731,B023
        for _ in range(60):  # the likelihood has one maximum
            a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        g = (lo + hi) / 2
        fitted = 1 - np.array([_zeta(g, v + 1) for v in x]) / _zeta(g, x[0])
        ks = float(np.abs(np.cumsum(w) / total - fitted).max())
        if best is None or ks < best[3]:
            best = (int(x[0]), int(total), g, ks)
    if best is None:
        return df.sparkSession.createDataFrame([], schema)
    z = best[3] * math.sqrt(best[1])
    p = min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101)))) if z > 0.2 else 1.0
    return df.sparkSession.createDataFrame([(*best, p)], schema)


def normal_p(z: float) -> float:
    """Two-sided p-value of a normal score."""
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    """Upper-tail p-value of an F statistic."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-30)
        c = (1 + num / c) or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def sequential_anova(df: DataFrame, value: str, factors: list[str]) -> list[tuple[str, int, float]]:
    """(factor, degrees of freedom, sum of squares) in the order given, by nested least squares on factor levels.

    The moments of the design (levels squared, a bounded specification) are summed by Spark; only they reach the driver.
    """
    import numpy as np

    t = df.where(F.col(value).isNotNull()).dropna(subset=factors)
    cells = t.groupBy(*factors).agg(F.count("*").alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).limit(100_001).collect()
    if not cells or len(cells) > 100_000:
        raise ValueError("between 1 and 100,000 combinations of levels are needed")
    n, s = np.array([c._n for c in cells], float), np.array([c._s for c in cells], float)
    design, before, out = [np.ones(len(cells))], None, []
    for k in [None, *factors]:
        if k is not None:
            levels = sorted({c[k] for c in cells}, key=str)[1:]
            design += [np.array([float(c[k] == level) for c in cells]) for level in levels]
        x = np.stack(design, 1)
        a, b = x.T @ (x * n[:, None]), x.T @ s
        beta = np.linalg.lstsq(a, b, rcond=None)[0]
        fitted, rank = float(beta @ b), int(np.linalg.matrix_rank(a))
        if before is not None:
            out.append((k, rank - before[1], fitted - before[0]))
        before = (fitted, rank)
    return [*out, ("residuals", int(n.sum()) - before[1], sum(c._q for c in cells) - before[0])]


def glm(df: DataFrame, label: str, terms: list[tuple[str, ...]], family: str, link: str, max_iter: int = 25) -> list[tuple[str, float, float]]:
    """(term, estimate, p-value) of a generalised linear model; a term of several columns is their product."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    t = df.dropna(subset=[label, *{c for term in terms for c in term}])
    for i, term in enumerate(terms):
        product = F.lit(1.0)
        for c in term:
            product = product * F.col(c)
        t = t.withColumn(f"_t{i}", product)
    data = VectorAssembler(inputCols=[f"_t{i}" for i in range(len(terms))], outputCol="_features").transform(t)
    model = GeneralizedLinearRegression(family=family, link=link, labelCol=label, featuresCol="_features", maxIter=max_iter).fit(data)
    p = model.summary.pValues
    return [("(intercept)", float(model.intercept), float(p[-1])), *((":".join(term), float(v), float(q)) for term, v, q in zip(terms, model.coefficients, p))]
