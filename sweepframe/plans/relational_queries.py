"""Joins, set operations, reshaping and scalar functions over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import dated_precision
from ..operators.graphs import best_overlap, triangles
from ..operators.ordered import last_known, running_sum
from .catalogue_queries import BY_FILE, by_file
from .registry import Registry, table

R = Registry()


@R.query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_dimensions(spark, d):
    """Inner joins with different key names; the small dimensions are broadcast by the planner's size estimate."""
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "n_name", "r_name")


@R.query("SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum(l_quantity * f), 4) AS v FROM lineitem JOIN (SELECT l_returnflag, l_linenumber, avg(l_discount) AS f FROM lineitem GROUP BY ALL) USING (l_returnflag, l_linenumber) GROUP BY ALL")
def join_inner_multi(spark, d):
    t = table(spark, d, "lineitem")
    f = t.groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("f"))
    return t.join(f, ["l_returnflag", "l_linenumber"]).groupBy("l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_quantity") * F.col("f")), 4).alias("v"))


@R.query("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
def join_right_keyed(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "right").select("c_custkey", "o_orderkey")


@R.query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@R.query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.query("SELECT s_suppkey AS key, p_brand, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def join_rename_keys(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return t.groupBy(F.col("s_suppkey").alias("key"), "p_brand").agg(F.count("*").alias("n"))


@R.query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT c_custkey AS k, c_acctbal FROM customer), c AS (SELECT c_custkey AS k, c_mktsegment FROM customer WHERE c_acctbal > 0)
SELECT k, n, c_acctbal, c_mktsegment FROM a NATURAL JOIN b NATURAL JOIN c""")
def join_nway_natural(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    a = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    out = a
    for t in (c.select("k", "c_acctbal"), c.where("c_acctbal > 0").select("k", "c_mktsegment")):
        out = out.join(t, [x for x in out.columns if x in t.columns])
    return out


@R.query("""WITH k AS (SELECT event_type, ts AS kt, max(value) AS f FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT e.event_id, round(k.f, 6) AS f FROM events e ASOF LEFT JOIN k ON e.ts >= k.kt""")
def asof_step_lookup(spark, d):
    """The step function of purchases at every event: the last knot at or before it (union and running last value)."""
    t = table(spark, d, "events")
    knots = t.where("event_type = 'purchase'").groupBy("ts").agg(F.max("value").alias("f")).select("ts", F.lit(0).alias("_o"), F.lit(None).cast("bigint").alias("event_id"), "f")
    line = knots.unionByName(t.select("ts", F.lit(1).alias("_o"), "event_id", F.lit(None).cast("double").alias("f"))).withColumn("_all", F.lit(0))
    return last_known(line, ["_all"], ["ts", "_o", "event_id"], "f", "g").where("_o = 1").select("event_id", F.round("g", 6).alias("f"))


@R.query("""WITH b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS k FROM b GROUP BY ALL)
SELECT r_name, count(*) AS suppliers, sum(k)::BIGINT AS parts, max(k) AS largest FROM n JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def set_sizes(spark, d):
    n = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.count("*").alias("k"))
    t = n.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t.groupBy("r_name").agg(F.count("*").alias("suppliers"), F.sum("k").alias("parts"), F.max("k").alias("largest"))


@R.query("SELECT l_orderkey, l_linenumber, parameter, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR parameter IN (l_quantity, l_discount, l_tax))")
def melt_params(spark, d):
    c = ["l_quantity", "l_discount", "l_tax"]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *c).unpivot(["l_orderkey", "l_linenumber"], c, "parameter", "value")


@R.query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY ALL")
def pivot_params(spark, d):
    p = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.fillna(0, ["F", "O", "P"])


@R.query("""WITH w AS (SELECT l_returnflag, round(min(l_tax), 4) AS "tax.lower", round(max(l_tax), 4) AS "tax.upper", round(min(l_discount), 4) AS "discount.lower", round(max(l_discount), 4) AS "discount.upper" FROM lineitem GROUP BY ALL), u AS (SELECT l_returnflag, split_part(n, '.', 1) AS parameter, split_part(n, '.', 2) AS bound, v FROM w UNPIVOT (v FOR n IN ("tax.lower", "tax.upper", "discount.lower", "discount.upper")))
SELECT l_returnflag, parameter, max(v) FILTER (bound = 'lower') AS lower, max(v) FILTER (bound = 'upper') AS upper FROM u GROUP BY ALL""")
def split_suffix_reshape(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[F.round(getattr(F, f)(f"l_{p}"), 4).alias(f"{p}_{b}") for p in ("tax", "discount") for f, b in (("min", "lower"), ("max", "upper"))])
    u = t.unpivot("l_returnflag", [c for c in t.columns if c != "l_returnflag"], "n", "v").withColumns({"parameter": F.split("n", "_")[0], "bound": F.split("n", "_")[1]})
    return u.groupBy("l_returnflag", "parameter").pivot("bound", ["lower", "upper"]).agg(F.max("v"))


@R.query("SELECT * FROM (SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer) UNION ALL BY NAME (SELECT s_suppkey AS key, s_name AS name, s_acctbal AS acctbal, s_nationkey AS nation FROM supplier)")
def union_by_name_null_fill(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


def _keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")), table(spark, d, "orders").select(F.col("o_custkey").alias("key"))


@R.query("SELECT c_custkey AS key FROM customer UNION SELECT o_custkey FROM orders")
def set_union(spark, d):
    a, b = _keys(spark, d)
    return a.union(b).distinct()


@R.query("SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@R.query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    a, b = _keys(spark, d)
    return a.subtract(b)


@R.query("(SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey * 2 FROM orders) UNION (SELECT o_custkey * 2 FROM orders EXCEPT SELECT c_custkey FROM customer)")
def set_symmetric_difference(spark, d):
    a, b = _keys(spark, d)
    b = b.select((F.col("key") * 2).alias("key"))
    return a.subtract(b).union(b.subtract(a)).distinct()


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM lineitem GROUP BY ALL")
def frequency_table(spark, d):
    t = table(spark, d, "lineitem")
    n = t.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / t.agg(F.count("*")).scalar(), 8))


@R.query("SELECT floor(l_extendedprice / 1000)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 1000).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 OR o_orderpriority LIKE '1%' THEN 'A' WHEN o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus IN ('F', 'P') THEN 'B' ELSE 'C' END AS class FROM orders WHERE o_orderdate IS NOT NULL AND (o_orderstatus <> 'F' OR o_totalprice >= 1000)")
def conditional_filters(spark, d):
    p, s = F.col("o_totalprice"), F.col("o_orderstatus")
    c = F.when((p > 200000) | F.col("o_orderpriority").startswith("1"), "A").when(p.between(100000, 200000) & s.isin("F", "P"), "B").otherwise("C")
    return table(spark, d, "orders").where(F.col("o_orderdate").isNotNull() & ((s != "F") | (p >= 1000))).select("o_orderkey", c.alias("class"))


@R.query("""SELECT p_partkey, replace(p_brand, '#', '-') AS brand, upper(split_part(p_type, ' ', 1)) AS kind, array_to_string(list_sort(string_split(p_type, ' ')), '+') AS canonical, regexp_extract(p_name, '([0-9]+)$', 1) AS digits, printf('%.1f', p_retailprice) AS price, p_type LIKE '%STEEL%' AS steel, p_size // 7 AS q, p_size % 7 AS r, round(log10(p_retailprice), 6) AS l FROM part""")
def string_ops(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "#", "-").alias("brand"), F.upper(F.split(t, " ")[0]).alias("kind"), F.array_join(F.sort_array(F.split(t, " ")), "+").alias("canonical"), F.regexp_extract("p_name", r"([0-9]+)$", 1).alias("digits"), F.format_string("%.1f", "p_retailprice").alias("price"), t.contains("STEEL").alias("steel"), F.floor(F.col("p_size") / 7).cast("int").alias("q"), (F.col("p_size") % 7).alias("r"), F.round(F.log10("p_retailprice"), 6).alias("l"))


@R.query("""SELECT file_id, CASE WHEN fmt = 'tsv' THEN 'days_' || (written_at::DATE - DATE '1970-01-01') WHEN fmt = 'nwk' THEN 'months_' || ((written_at::DATE - DATE '1970-01-01') * 86400 // 2628000) WHEN fmt = 'mtx' THEN 'years_' || ((written_at::DATE - DATE '1970-01-01') * 86400 // 31536000) ELSE 'NA_0' END AS stamp FROM trace_files""")
def date_precision_fallback(spark, d):
    """Days, else months, else years since 1970, prefixed with the unit, by the precision of the text."""
    text = F.when(F.col("fmt") == "tsv", F.date_format("written_at", "dd-MMM-yyyy")).when(F.col("fmt") == "nwk", F.date_format("written_at", "dd-MMM-yyyy")).when(F.col("fmt") == "mtx", F.date_format("written_at", "dd-MMM-yyyy")).otherwise("unknown")
    unit = F.when(F.col("fmt") == "tsv", "days").when(F.col("fmt") == "nwk", "months").otherwise("years")
    return table(spark, d, "trace_files").select("file_id", dated_precision(text, unit).alias("stamp"))


@R.query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events WHERE (props::JSON ->> 'k')::BIGINT % 3 = 0")
def filter_nested_props(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").select("event_id", k.alias("k")).where("k % 3 = 0")


@R.query("""SELECT gbid, gene, count(*) AS n, min(least(start, "end"))::BIGINT AS first, max(greatest(start, "end"))::BIGINT AS last, sum(abs("end" - start) + 1)::BIGINT AS bases FROM (SELECT DISTINCT gbid, gene, start, "end" FROM gene_intervals WHERE gene IS NOT NULL AND start IS NOT NULL AND "end" IS NOT NULL) GROUP BY ALL""")
def gene_intervals_by_gene(spark, d):
    t = table(spark, d, "gene_intervals").where("gene is not null and start is not null and `end` is not null").select("gbid", "gene", "start", "end").distinct()
    return t.groupBy("gbid", "gene").agg(F.count("*").alias("n"), F.min(F.least("start", "end")).cast("bigint").alias("first"), F.max(F.greatest("start", "end")).cast("bigint").alias("last"), F.sum((F.abs(F.col("end") - F.col("start")) + 1).cast("bigint")).alias("bases"))


@R.query("SELECT label, count(*) AS n, round(avg(norm), 6) AS mean_norm, round(max(norm), 6) AS max_norm FROM (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings) GROUP BY ALL")
def embedding_norms(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return table(spark, d, "embeddings").select("label", norm.alias("norm")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"), F.round(F.max("norm"), 6).alias("max_norm"))


@R.query("""WITH b AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), n AS (SELECT s, count(*) AS k FROM b GROUP BY ALL), o AS (SELECT x.s AS query_id, y.s AS id, count(*) AS shared FROM b x JOIN b y ON x.p = y.p AND x.s <> y.s WHERE x.s % 100 = 0 GROUP BY ALL)
SELECT query_id, id, shared, round(shared / (q.k + n.k - shared), 8) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared / (q.k + n.k - shared) DESC, id) AS r, q.k, n.k FROM o JOIN n q ON q.s = query_id JOIN n ON n.s = id) t JOIN n q ON q.s = query_id JOIN n ON n.s = id WHERE r = 1""")
def set_overlap_best(spark, d):
    """The supplier whose parts overlap most with those of each supplier whose number is divisible by 100, among all suppliers."""
    b = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("part")).distinct()
    return best_overlap(b, "id", "part", b.where("id % 100 = 0")).withColumn("jaccard", F.round("jaccard", 8))


@R.query(f"""WITH {BY_FILE}, s AS (SELECT path, min(step) AS step FROM fil GROUP BY path) SELECT l.path, l.dep_path, c.step AS step, p.step AS dep_step, CASE WHEN c.step = p.step THEN c.step ELSE coalesce(least(c.step, p.step), '?') END AS label FROM (SELECT DISTINCT path, dep_path FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL) l LEFT JOIN s c ON c.path = l.path LEFT JOIN s p ON p.path = l.dep_path""")
def edge_labels(spark, d):
    """The steps of both ends of every link, looked up in one table, and a label of the link from the two."""
    steps = by_file(spark, d, "trace_files").groupBy("path").agg(F.min("step").alias("step"))
    links = by_file(spark, d, "expt_dependencies").where("path is not null and dep_path is not null").select("path", "dep_path").distinct()
    both = links.join(steps, "path", "left").join(steps.select(F.col("path").alias("dep_path"), F.col("step").alias("dep_step")), "dep_path", "left")
    return both.select("path", "dep_path", "step", "dep_step", F.when(F.col("step") == F.col("dep_step"), F.col("step")).otherwise(F.coalesce(F.least("step", "dep_step"), F.lit("?"))).alias("label"))


@R.query("SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand))::BIGINT AS code FROM part")
def dense_codes(spark, d):
    """A factor as dense integer codes in the order of its levels."""
    t = table(spark, d, "part")
    codes = running_sum(t.select("p_brand").distinct().withColumn("_all", F.lit(0)), ["_all"], ["p_brand"], {"code": F.lit(1)})
    return t.join(codes, "p_brand").select("p_partkey", F.col("code").cast("bigint").alias("code"))


@R.query("SELECT l_returnflag, l_linestatus, round(avg(l_tax), 8) AS l_tax, round(avg(l_discount), 8) AS l_discount, round(max(l_quantity), 8) AS top FROM lineitem GROUP BY ALL")
def aggregate_by_name(spark, d):
    """Columns chosen by pattern, aggregated over facets by functions given by name."""
    t = table(spark, d, "lineitem")
    named = [c for c in t.columns if re.fullmatch(r"l_(tax|disc).*", c)]
    return t.groupBy("l_returnflag", "l_linestatus").agg(*[F.round(F.expr(f"avg({c})"), 8).alias(c) for c in named], F.round(F.expr("max(l_quantity)"), 8).alias("top"))


@R.query("SELECT link_id, path, dep_path FROM expt_dependencies WHERE path > dep_path AND recorded_at IS NOT NULL")
def compare_columns(spark, d):
    """Rows where one column is greater than another."""
    return table(spark, d, "expt_dependencies").where((F.col("path") > F.col("dep_path")) & F.col("recorded_at").isNotNull()).select("link_id", "path", "dep_path")


@R.query("""SELECT o_orderpriority, n, (row_number() OVER (ORDER BY CASE left(o_orderpriority, 1) WHEN '3' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 9 END, o_orderpriority))::INTEGER AS position FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""")
def custom_order(spark, d):
    """Categories in a given order: three named first, the rest by text."""
    t = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    first = F.substring("o_orderpriority", 1, 1)
    rank = F.when(first == "3", 0).when(first == "1", 1).when(first == "2", 2).otherwise(9)
    return running_sum(t.withColumns({"_all": F.lit(0), "_r": rank}), ["_all"], ["_r", "o_orderpriority"], {"position": F.lit(1)}).select("o_orderpriority", "n", F.col("position").cast("int").alias("position"))


@R.query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS j FROM events) WHERE k > 1 AND j > 1""")
def drop_first_and_last(spark, d):
    """Every user's events but the first and the last, found by aggregates, without sorting a user's events."""
    t = table(spark, d, "events").select("user_id", "ts", "event_id")
    ends = t.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b"))
    j = t.alias("t").join(ends.alias("e"), F.col("t.user_id").eqNullSafe(F.col("e.user_id")))
    return j.where((F.col("t.event_id") != F.col("a.event_id")) & (F.col("t.event_id") != F.col("b.event_id"))).select("t.user_id", "t.event_id")


@R.query("""WITH a AS (SELECT l_linenumber AS replicate, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_linenumber AS replicate, avg(l_tax) AS tax FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT replicate, round(a.tax, 8) AS tax_a, round(b.tax, 8) AS tax_r FROM a FULL JOIN b USING (replicate)""")
def bind_by_replicate(spark, d):
    """Two results side by side by replicate."""
    one = lambda flag, name: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_linenumber").alias("replicate")).agg(F.round(F.avg("l_tax"), 8).alias(name))
    return one("A", "tax_a").join(one("R", "tax_r"), "replicate", "full")


@R.query("SELECT event_id, round(value * cos(radians(event_id % 360)), 6) + 0.0 AS x, round(value * sin(radians(event_id % 360)), 6) + 0.0 AS y FROM events WHERE value IS NOT NULL")
def polar_to_rectangular(spark, d):
    angle = F.radians(F.col("event_id") % 360)
    return table(spark, d, "events").where("value is not null").select("event_id", (F.round(F.col("value") * F.cos(angle), 6) + 0.0).alias("x"), (F.round(F.col("value") * F.sin(angle), 6) + 0.0).alias("y"))


@R.query("SELECT event_id, round(p, 8) AS p, round(p * (1 - p), 8) AS d1, round(p * (1 - p) * (1 - 2 * p), 8) AS d2 FROM (SELECT event_id, 1 / (1 + exp(-value / 100)) AS p FROM events WHERE value IS NOT NULL)")
def logistic_derivatives(spark, d):
    """The logistic function and its first two derivatives."""
    p = 1 / (1 + F.exp(-F.col("value") / 100))
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(p, 8).alias("p"), F.round(p * (1 - p), 8).alias("d1"), F.round(p * (1 - p) * (1 - 2 * p), 8).alias("d2"))


@R.query("""WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem WHERE l_suppkey <> l_partkey AND l_partkey <= (SELECT max(s_suppkey) FROM supplier)), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), d AS (SELECT a AS node, count(*) AS k FROM s GROUP BY ALL),
 t AS (SELECT count(*) AS n FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b) SELECT (SELECT n FROM t) AS triangles, round(3.0 * (SELECT n FROM t) / sum(k * (k - 1) / 2), 8) AS transitivity FROM d""")
def transitivity(spark, d):
    """Triangles and transitivity of the subgraph that the suppliers' numbers induce in the graph of suppliers and parts."""
    top = table(spark, d, "supplier").agg(F.max("s_suppkey")).scalar()
    e = table(spark, d, "lineitem").where(F.col("l_partkey") <= top).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return triangles(e).withColumn("transitivity", F.round("transitivity", 8))


QUERIES, ORACLE = R.queries, R.oracle
