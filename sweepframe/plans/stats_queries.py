"""Statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .registry import Registry, table

R = Registry()


@R.query("""WITH e AS (SELECT event_type, value, user_id FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
 r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM e)
SELECT event_type, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r GROUP BY ALL""")
def spearman_corr(spark, d):
    return S.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id").withColumn("rho", F.round("rho", 8))


@R.query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r, round(pow(corr(l_quantity, l_extendedprice), 2), 8) AS r2 FROM lineitem GROUP BY ALL")
def pearson_r2(spark, d):
    r = F.corr("l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(r, 8).alias("r"), F.round(F.pow(r, 2), 8).alias("r2"))


@R.query("""WITH r AS (SELECT o_orderstatus = 'F' AS b, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL)
SELECT count(*) FILTER (NOT b) AS n1, count(*) FILTER (b) AS n2, round(sum(r) FILTER (NOT b) - count(*) FILTER (NOT b) * (count(*) FILTER (NOT b) + 1) / 2.0, 2) AS w FROM r""")
def rank_sum_w(spark, d):
    t = table(spark, d, "orders").where("o_orderstatus is not null")
    return S.rank_sum(t, "o_totalprice", F.col("o_orderstatus") == "F").select("n1", "n2", F.round("w", 2).alias("w"))


@R.query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM events WHERE value IS NOT NULL GROUP BY ALL), t AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(ss) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM g)
SELECT k, n, round(b, 4) AS ss_between, round(w, 2) AS ss_within, round(b / (k - 1) / (w / (n - k)), 6) AS f FROM t""")
def anova_oneway_f(spark, d):
    return S.anova(table(spark, d, "events"), "event_type", "value").select("k", "n", F.round("ss_between", 4).alias("ss_between"), F.round("ss_within", 2).alias("ss_within"), F.round("f", 6).alias("f"))


@R.query("""WITH p AS (SELECT event_type, round(exp(-abs(avg(value) / stddev_samp(value))), 8) AS p FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p, event_type) AS r, count(*) OVER () AS n FROM p)
SELECT event_type, p, round(least(1.0, max(p * (n - r + 1)) OVER (ORDER BY p, event_type)), 8) AS p_holm FROM r""")
def holm_adjust(spark, d):
    p = table(spark, d, "events").groupBy("event_type").agg(F.round(F.exp(-F.abs(F.avg("value") / F.stddev_samp("value"))), 8).alias("p"))
    return S.holm(p, "p", ["event_type"]).withColumn("p_holm", F.round("p_holm", 8))


@R.query("""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y, (l_orderkey * 7 + l_linenumber) % 2 AS fold, (l_orderkey % 10)::INTEGER AS replicate FROM lineitem), f AS (SELECT replicate, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t WHERE fold = 0 GROUP BY ALL), c AS (SELECT replicate, corr(x, y) AS r FROM t WHERE fold = 1 GROUP BY ALL)
SELECT replicate, round(s, 4) AS slope, round(i, 2) AS intercept, round(coalesce(pow(r, 2), 0), 8) AS rsquared FROM f LEFT JOIN c USING (replicate)""")
def lm_cv(spark, d):
    out = S.linear_cv(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 2, (F.col("l_orderkey") % 10).cast("int"))
    return out.select("replicate", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("rsquared", 8).alias("rsquared"))


@R.query("""WITH t AS (SELECT l_quantity AS x, l_extendedprice AS y, r::INTEGER AS replicate, (l_orderkey * 7 + l_linenumber + r * 104729) * 2654435761 % 4294967296 // 65536 % 2 AS fold FROM lineitem, range(20) g(r)), f AS (SELECT replicate, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM t WHERE fold = 0 GROUP BY ALL), c AS (SELECT replicate, corr(x, y) AS r FROM t WHERE fold = 1 GROUP BY ALL)
SELECT replicate, round(s, 4) AS slope, round(i, 2) AS intercept, round(coalesce(pow(r, 2), 0), 8) AS rsquared FROM f LEFT JOIN c USING (replicate)""")
def lm_cv_replicates(spark, d):
    """Twenty replicates, each with a new split of all lines into halves: a line fitted on one, its fit on the other."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("r"))
    split = F.floor((F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("r") * 104729) * F.lit(2654435761) % F.lit(4294967296) / 65536) % 2
    out = S.linear_cv(t, "l_quantity", "l_extendedprice", split, F.col("r"))
    return out.select("replicate", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("rsquared", 8).alias("rsquared"))


@R.query("""WITH t AS (SELECT o_totalprice AS x, count(*) FILTER (o_orderstatus <> 'F') AS a, count(*) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY ALL), c AS (SELECT a, b, sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS diff, sum(a + b) OVER () AS n FROM t)
SELECT round(max(abs(diff)), 8) AS ks, round(sum(diff * diff * (a + b) / n), 10) AS cvm FROM c""")
def ks_cvm_statistic(spark, d):
    return S.ks_cvm(table(spark, d, "orders"), "o_totalprice", F.col("o_orderstatus") == "F").select(F.round("ks", 8).alias("ks"), F.round("cvm", 10).alias("cvm"))


@R.query("WITH k AS (SELECT l_partkey, count(*) AS k FROM lineitem GROUP BY ALL) SELECT count(*) AS n, round(1 + count(*) / sum(ln(k / 0.5)), 8) AS gamma FROM k")
def power_law_mle(spark, d):
    k = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k"))
    return S.power_law(k, "k").withColumn("gamma", F.round("gamma", 8))


@R.query("SELECT c_nationkey, round(sum(w * x) / sum(w), 4) AS mean, round(pow(sum(w), 2) / sum(w * w), 4) AS ess FROM (SELECT c_nationkey, c_acctbal AS x, 1.0 + (c_custkey % 7) AS w FROM customer) GROUP BY ALL")
def effective_sample_size(spark, d):
    t = table(spark, d, "customer").select("c_nationkey", F.col("c_acctbal").alias("x"), (1.0 + F.col("c_custkey") % 7).alias("w"))
    return t.groupBy("c_nationkey").agg(F.round(F.sum(F.col("w") * F.col("x")) / F.sum("w"), 4).alias("mean"), F.round(F.pow(F.sum("w"), 2) / F.sum(F.col("w") * F.col("w")), 4).alias("ess"))


@R.query()
def glm_gamma_log(spark, d):
    """Gamma regression with log link and an interaction, fitted by Spark ML over all lines."""
    t = table(spark, d, "lineitem").where("l_extendedprice > 0").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("c"))
    rows = S.glm(t, "label", [("q",), ("c",), ("q", "c")], "gamma", "log")
    return spark.createDataFrame([(n, float(v), float(p)) for n, v, p in rows], "term string, estimate double, p double")


@R.query()
def power_law_tail(spark, d):
    """The tail of the numbers of lines per part."""
    return S.power_law_fit(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k")), "k")


@R.query()
def p_values(spark, d):
    """Statistic and p-value of the rank-sum test of order prices by status, the analysis of variance of event values and the
    rank correlations of each event type, the last also adjusted by Holm's method."""
    w = S.rank_sum(table(spark, d, "orders").where("o_orderstatus is not null"), "o_totalprice", F.col("o_orderstatus") == "F").first()
    f = S.anova(table(spark, d, "events"), "event_type", "value").first()
    rho = S.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id").orderBy("event_type").collect()  # one row per type
    rows = [("rank_sum", w.z, S.normal_p(w.z)), ("anova", f.f, S.f_p(f.f, f.k - 1, f.n - f.k))]
    t = [(r.event_type, r.rho, S.student_p(r.rho * ((r.n - 2) / (1 - r.rho**2)) ** 0.5, r.n - 2)) for r in rho]
    out = spark.createDataFrame([(a, float(b), float(c)) for a, b, c in rows], "test string, statistic double, p double").withColumn("p_holm", F.lit(None).cast("double"))
    adjusted = S.holm(spark.createDataFrame([("spearman " + a, float(b), float(c)) for a, b, c in t], "test string, statistic double, p double"), "p", ["test"])
    return out.unionByName(adjusted)


QUERIES, ORACLE = R.queries, R.oracle
