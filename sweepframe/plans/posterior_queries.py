"""Posterior summaries over lineitem as a particle trace: run = flag and status, iteration = line number, weight = price."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import weighted as W
from ..operators.ordered import previous, running_sum
from .registry import Registry, table

R = Registry()
RUN = ["l_returnflag", "l_linestatus"]
LATEST_SQL = "latest AS (SELECT l.* FROM lineitem l JOIN (SELECT l_returnflag, l_linestatus, max(l_linenumber) AS top FROM lineitem GROUP BY ALL) t USING (l_returnflag, l_linestatus) WHERE l_linenumber = top)"


def _latest(spark, d) -> DataFrame:
    return W.latest(table(spark, d, "lineitem"), RUN, "l_linenumber")


def _melt(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*RUN, F.col("l_extendedprice").alias("weight"), *columns).unpivot([*RUN, "weight"], columns, "parameter", "value")


def _hpd_sql(conf: float, source: str = "melted") -> str:
    """Candidate enumeration on the knots of each group's distribution function."""
    return f"""pts AS (SELECT l_returnflag, l_linestatus, parameter, value AS x, sum(weight) AS w FROM {source} GROUP BY ALL),
 cdf AS (SELECT *, CASE WHEN x = min(x) OVER g THEN 0 ELSE sum(w) OVER (g2) / sum(w) OVER g END AS f FROM pts WINDOW g AS (PARTITION BY l_returnflag, l_linestatus, parameter), g2 AS (PARTITION BY l_returnflag, l_linestatus, parameter ORDER BY x)),
 knots AS (SELECT *, lead(x) OVER k AS nx, lead(f) OVER k AS nf FROM cdf WINDOW k AS (PARTITION BY l_returnflag, l_linestatus, parameter ORDER BY x)),
 cand AS (SELECT DISTINCT l_returnflag, l_linestatus, parameter, s FROM (SELECT l_returnflag, l_linestatus, parameter, unnest([f, f - {conf}, {1 - conf}]) AS s FROM knots) WHERE s >= 0 AND s <= {1 - conf}),
 probe AS (SELECT *, s AS p, 'lower' AS side FROM cand UNION ALL SELECT *, s + {conf}, 'upper' FROM cand),
 hit AS (SELECT p.l_returnflag, p.l_linestatus, p.parameter, p.s, p.side, CASE WHEN k.nx IS NULL OR k.nf = k.f THEN k.x ELSE k.x + (k.nx - k.x) * (p.p - k.f) / (k.nf - k.f) END AS v,
   row_number() OVER (PARTITION BY p.l_returnflag, p.l_linestatus, p.parameter, p.s, p.side ORDER BY k.f DESC, k.x DESC) AS rn
   FROM probe p JOIN knots k ON p.l_returnflag = k.l_returnflag AND p.l_linestatus = k.l_linestatus AND p.parameter = k.parameter AND k.f <= p.p),
 spans AS (SELECT l_returnflag, l_linestatus, parameter, s, max(v) FILTER (side = 'lower') AS lower, max(v) FILTER (side = 'upper') AS upper FROM hit WHERE rn = 1 GROUP BY ALL),
 best AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus, parameter ORDER BY round(upper - lower, 12), s) AS rank FROM spans)"""


MELTED_SQL = "melted AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS weight, parameter, value FROM (SELECT l_returnflag, l_linestatus, l_extendedprice, l_discount, l_tax FROM {0}) UNPIVOT (value FOR parameter IN (l_discount, l_tax)))"


@R.query(f"""WITH {LATEST_SQL}, {MELTED_SQL.format('latest')}, {_hpd_sql(0.95)}
SELECT b.l_returnflag, b.l_linestatus, b.parameter, round(m.mean, 6) AS mean, round(lower, 6) AS lower_95, round(upper, 6) AS upper_95
FROM best b JOIN (SELECT l_returnflag, l_linestatus, parameter, sum(value * weight) / sum(weight) AS mean FROM melted GROUP BY ALL) m USING (l_returnflag, l_linestatus, parameter) WHERE rank = 1""")
def posterior_summary(spark, d):
    """Latest iteration, melted parameters, weighted mean and 95 % highest-density interval."""
    m = _melt(_latest(spark, d), ["l_discount", "l_tax"])
    keys = [*RUN, "parameter"]
    mean = m.groupBy(*keys).agg(F.round(W.weighted_mean("value", "weight"), 6).alias("mean"))
    span = W.hpd(m, keys, "value", "weight", 0.95).select(*keys, F.round("lower", 6).alias("lower_95"), F.round("upper", 6).alias("upper_95"))
    return mean.join(span, keys)


@R.query(f"WITH {LATEST_SQL} SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS weight FROM latest GROUP BY ALL")
def latest_iteration(spark, d):
    return _latest(spark, d).groupBy(*RUN, "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("weight"))


@R.query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem)")
def latest_iteration_global(spark, d):
    t = table(spark, d, "lineitem")
    return t.where(F.col("l_linenumber") == t.agg(F.max("l_linenumber")).scalar()).select("l_orderkey", "l_partkey", "l_linenumber")


@R.query("SELECT l_returnflag, l_linestatus, l_linenumber, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 8) AS mean_discount, round(sum(l_tax * l_extendedprice) / sum(l_extendedprice), 8) AS mean_tax, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS mean_quantity FROM lineitem GROUP BY ALL")
def weighted_mean_by_group(spark, d):
    means = [F.round(W.weighted_mean(c, "l_extendedprice"), r).alias(n) for c, r, n in (("l_discount", 8, "mean_discount"), ("l_tax", 8, "mean_tax"), ("l_quantity", 6, "mean_quantity"))]
    return table(spark, d, "lineitem").groupBy(*RUN, "l_linenumber").agg(*means)


@R.query("""WITH p AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, x, round(sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY x) / sum(w) OVER (PARTITION BY l_returnflag, l_linestatus), 8) AS f FROM p""")
def weighted_ecdf(spark, d):
    return W.ecdf(table(spark, d, "lineitem"), RUN, "l_quantity", "l_extendedprice").withColumn("f", F.round("f", 8))


@R.query(f"""WITH {MELTED_SQL.format('lineitem')}, a AS (WITH {_hpd_sql(0.95)} SELECT * FROM best WHERE rank = 1), b AS (WITH {_hpd_sql(0.5)} SELECT * FROM best WHERE rank = 1)
SELECT a.l_returnflag, a.l_linestatus, a.parameter, round(a.lower, 6) AS lower_95, round(a.upper, 6) AS upper_95, round(b.lower, 6) AS lower_50, round(b.upper, 6) AS upper_50 FROM a JOIN b USING (l_returnflag, l_linestatus, parameter)""")
def hpd_continuous_95_50(spark, d):
    m, keys = _melt(table(spark, d, "lineitem"), ["l_discount", "l_tax"]), [*RUN, "parameter"]
    out = [W.hpd(m, keys, "value", "weight", c).select(*keys, F.round("lower", 6).alias(f"lower_{n}"), F.round("upper", 6).alias(f"upper_{n}")) for c, n in ((0.95, 95), (0.5, 50))]
    return out[0].join(out[1], keys)


def _discrete_sql(conf: float) -> str:
    return f"""(WITH p AS (SELECT l_returnflag, l_linestatus, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL),
 c AS (SELECT *, round(sum(w) OVER o / sum(w) OVER g, 12) AS f, round((sum(w) OVER o - w) / sum(w) OVER g, 12) AS g0, first_value(x) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY w DESC, x) AS mode FROM p WINDOW g AS (PARTITION BY l_returnflag, l_linestatus), o AS (PARTITION BY l_returnflag, l_linestatus ORDER BY x)),
 r AS (SELECT a.l_returnflag, a.l_linestatus, a.x AS lower, b.x AS upper, round(b.f - a.g0, 9) AS density, CASE WHEN a.mode BETWEEN a.x AND b.x THEN 0 ELSE 1 END AS off FROM c a JOIN c b ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.x <= b.x AND b.f >= round(a.g0 + {conf}, 12))
 SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY upper - lower, off, density, lower) AS rank FROM r)"""


@R.query(f"SELECT a.l_returnflag, a.l_linestatus, a.lower AS lower_95, a.upper AS upper_95, b.lower AS lower_50, b.upper AS upper_50 FROM {_discrete_sql(0.95)} a JOIN {_discrete_sql(0.5)} b USING (l_returnflag, l_linestatus) WHERE a.rank = 1 AND b.rank = 1")
def hpd_discrete_95_50(spark, d):
    t = table(spark, d, "lineitem")
    out = [W.hpd_discrete(t, RUN, "l_quantity", "l_extendedprice", c).select(*RUN, F.col("lower").alias(f"lower_{n}"), F.col("upper").alias(f"upper_{n}")) for c, n in ((0.95, 95), (0.5, 50))]
    return out[0].join(out[1], RUN)


@R.query("""WITH r AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
 s AS (SELECT a.event_type, a.x AS lower, b.x AS upper, row_number() OVER (PARTITION BY a.event_type ORDER BY round(b.x - a.x, 9), a.x) AS k FROM r a JOIN r b ON a.event_type = b.event_type AND b.r = a.r + greatest(1, ceil(a.n * 0.95)) - 1)
SELECT event_type, round(lower, 6) AS lower, round(upper, 6) AS upper FROM s WHERE k = 1""")
def hpd_order_statistic(spark, d):
    return W.hpd_ordered(table(spark, d, "events"), ["event_type"], "value", 0.95).select("event_type", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


QUANTILES = [0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975]


@R.query("SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS q{str(q)[2:]}" for q in QUANTILES) + " FROM events GROUP BY ALL")
def quantile_summary(spark, d):
    p = W.quantiles(table(spark, d, "events"), ["event_type"], "value", QUANTILES)
    return p.select("event_type", *[F.round(f"q{i}", 6).alias(f"q{str(q)[2:]}") for i, q in enumerate(QUANTILES)])


@R.query("SELECT o_orderpriority, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, count(*) AS n FROM orders GROUP BY ALL")
def median_iqr(spark, d):
    p = W.quantiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", [0.25, 0.5, 0.75])
    return p.select("o_orderpriority", F.round("q1", 4).alias("median"), F.round(F.col("q2") - F.col("q0"), 4).alias("iqr"), "n")


@R.query("""WITH s AS (SELECT l_returnflag, l_quantity, median(l_discount * l_extendedprice) AS score FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_quantity AS point_est FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(score, 6) DESC, l_quantity) AS k FROM s) WHERE k = 1""")
def argmax_grid(spark, d):
    t = table(spark, d, "lineitem").withColumn("score", F.col("l_discount") * F.col("l_extendedprice"))
    s = W.quantiles(t, ["l_returnflag", "l_quantity"], "score", [0.5])
    return W.arg_max(s, ["l_returnflag"], F.round("q0", 6), ["l_quantity"]).withColumnRenamed("l_quantity", "point_est")


@R.query("""WITH s AS (SELECT o_orderpriority, o_orderstatus, extract(year FROM o_orderdate)::INT AS y, avg(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT o_orderpriority, o_orderstatus, y FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(m, 6) DESC, o_orderstatus, y) AS k FROM s) WHERE k = 1""")
def best_metaparameters(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 6).alias("m"))
    return W.arg_max(s, ["o_orderpriority"], F.col("m"), ["o_orderstatus", "y"])


@R.query("""WITH n AS (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)
SELECT c_nationkey, c_custkey, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY abs(n - 10), c_custkey) AS k FROM n) WHERE k = 1""")
def nearest_to_target(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return W.arg_max(n, ["c_nationkey"], -F.abs(F.col("n") - 10), ["c_custkey", "n"])


@R.query("""WITH s AS (SELECT l_returnflag, l_quantity AS x, avg(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
 t AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)), a AS (SELECT l_returnflag, sum((nx - x) * (y + ny) / 2) AS area FROM t WHERE nx IS NOT NULL GROUP BY ALL)
SELECT s.l_returnflag, x, round(y / area, 8) AS density FROM s JOIN a USING (l_returnflag)""")
def area_normalised_score(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("x")).agg(F.avg("l_extendedprice").alias("y"))
    b = previous(s, ["l_returnflag"], ["x"], ["x", "y"], "b")
    area = b.groupBy("l_returnflag").agg(F.sum((F.col("x") - F.col("b.x")) * (F.col("y") + F.col("b.y")) / 2).alias("area"))
    return s.join(area, "l_returnflag").select("l_returnflag", "x", F.round(F.col("y") / F.col("area"), 8).alias("density"))


@R.query("WITH s AS (SELECT event_type, (user_id % 50) AS bin, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, bin, round(v / sum(v) OVER (PARTITION BY event_type), 8) AS share FROM s")
def sum_normalised_score(spark, d):
    s = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 50).alias("bin")).agg(F.sum("value").alias("v"))
    t = s.groupBy("event_type").agg(F.sum("v").alias("t"))
    return s.join(t, "event_type").select("event_type", "bin", F.round(F.col("v") / F.col("t"), 8).alias("share"))


KDE_SQL = "(SELECT g.x, {0} round(sum(p.w / p.t * exp(-pow((g.x - p.x) / 2.0, 2) / 2) / (2.0 * sqrt(2 * pi()))), 9) AS density FROM (SELECT *, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM (SELECT l_returnflag, l_quantity AS x, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL)) p, (SELECT unnest(range(0, 52))::DOUBLE AS x) g GROUP BY ALL)"


@R.query(f"SELECT l_returnflag, x AS mode FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY density DESC, x) AS k FROM {KDE_SQL.format('p.l_returnflag,')}) WHERE k = 1")
def kde_mode(spark, d):
    k = W.kde(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_extendedprice"), 2.0, list(range(52)))
    return W.arg_max(k.withColumn("density", F.round("density", 9)), ["l_returnflag"], F.col("density"), ["x"]).withColumnRenamed("x", "mode")


@R.query("""WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*) AS w FROM lineitem GROUP BY ALL), t AS (SELECT sum(w) AS t FROM p)
SELECT gx.x AS gx, gy.y AS gy, round(sum(w / t * exp(-pow((gx.x - p.x) / 5.0, 2) / 2 - pow((gy.y - p.y) / 0.02, 2) / 2) / (2 * pi() * 5.0 * 0.02)), 8) AS density
FROM p, t, (SELECT unnest(range(0, 51, 10))::DOUBLE AS x) gx, (SELECT unnest(range(0, 11, 2)) / 100.0 AS y) gy GROUP BY ALL""")
def kde_2d(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).agg(F.count("*").alias("w"))
    total = p.agg(F.sum("w")).first()[0] or 1
    g = p.withColumn("gx", F.explode(F.array(*[F.lit(float(i)) for i in range(0, 51, 10)]))).withColumn("gy", F.explode(F.array(*[F.lit(i / 100.0) for i in range(0, 11, 2)])))
    z = F.pow((F.col("gx") - F.col("x")) / 5.0, 2) / 2 + F.pow((F.col("gy") - F.col("y")) / 0.02, 2) / 2
    return g.groupBy("gx", "gy").agg(F.round(F.sum(F.col("w") / total * F.exp(-z) / (2 * F.pi() * 5.0 * 0.02)), 8).alias("density"))


@R.query("""SELECT o_orderpriority, count(*) AS n, round(avg(abs(e)), 4) AS mean_abs, round(avg(abs(e) / o_totalprice), 6) AS mean_rel, round(max(e) - min(e), 2) AS error_range
FROM (SELECT o_orderpriority, o_totalprice, s - o_totalprice AS e FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS s FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey) GROUP BY ALL""")
def error_metrics(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"))
    e = table(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("e", F.col("s") - F.col("o_totalprice"))
    return e.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(F.abs("e")), 4).alias("mean_abs"), F.round(F.avg(F.abs("e") / F.col("o_totalprice")), 6).alias("mean_rel"), F.round(F.max("e") - F.min("e"), 2).alias("error_range"))


@R.query("""WITH c AS (SELECT l_returnflag, l_linestatus, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS w, sum(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_orderkey * 10 + l_linenumber ROWS UNBOUNDED PRECEDING) AS c, sum(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS t FROM (SELECT l_returnflag, l_linestatus, l_orderkey, l_linenumber, sum(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL))
SELECT l_returnflag, l_linestatus, count(*) FILTER (copies > 0) AS rows_drawn, sum(copies)::BIGINT AS copies FROM (SELECT *, floor(round(c / t * 1000, 6)) - floor(round((c - w) / t * 1000, 6)) AS copies FROM c) GROUP BY ALL""")
def weighted_resample(spark, d):
    t = table(spark, d, "lineitem").groupBy(*RUN, (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.sum("l_extendedprice").alias("w"))
    r = W.systematic_resample(t, RUN, "id", "w", 1000)
    return r.groupBy(*RUN).agg(F.count_if(F.col("copies") > 0).alias("rows_drawn"), F.sum("copies").alias("copies"))


@R.query("WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey, o_orderkey, (sum(1) OVER w)::BIGINT AS n, round(sum(o_totalprice) OVER w, 2) AS total FROM t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
def cumulative_counts(spark, d):
    t = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return running_sum(t, ["o_custkey"], ["o_orderkey"], {"n": F.lit(1), "total": F.col("o_totalprice")}).select("o_custkey", "o_orderkey", F.col("n").cast("bigint").alias("n"), F.round("total", 2).alias("total"))


@R.query("SELECT user_id, event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS diff FROM events")
def first_difference(spark, d):
    p = previous(table(spark, d, "events").select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], ["value"], "b")
    return p.select("user_id", "event_id", F.round(F.col("value") - F.col("b.value"), 6).alias("diff"))


@R.query("SELECT r_name AS region, n_name, CASE WHEN row_number() OVER (PARTITION BY r_name ORDER BY n_name) > 1 THEN '' ELSE r_name END AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def blank_repeats(spark, d):
    t = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), "n_name")
    return t.withColumn("label", F.when(F.row_number().over(Window.partitionBy("region").orderBy("n_name")) > 1, "").otherwise(F.col("region")))


@R.query("SELECT user_id, event_id, round(value / max(value) OVER (PARTITION BY user_id), 8) AS scaled FROM events")
def normalise_by_group_max(spark, d):
    t = table(spark, d, "events")
    top = t.groupBy("user_id").agg(F.max("value").alias("top"))
    return t.join(top, "user_id").select("user_id", "event_id", F.round(F.col("value") / F.col("top"), 8).alias("scaled"))


@R.query("""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE -1 END AS step FROM events)
SELECT user_id, event_id, (sum(greatest(step, 0)) OVER w)::BIGINT AS infected, (sum(greatest(-step, 0)) OVER w)::BIGINT AS removed, (sum(step) OVER w)::BIGINT AS active FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def epidemic_trajectory(spark, d):
    """Running counts of typed events in time order: infections, removals and their difference."""
    step = F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1)
    t = table(spark, d, "events").select("user_id", "ts", "event_id", step.alias("step"))
    r = running_sum(t, ["user_id"], ["ts", "event_id"], {"infected": F.greatest(F.col("step"), F.lit(0)), "removed": F.greatest(-F.col("step"), F.lit(0)), "active": F.col("step")})
    return r.select("user_id", "event_id", *[F.col(c).cast("bigint").alias(c) for c in ("infected", "removed", "active")])


QUERIES, ORACLE = R.queries, R.oracle
