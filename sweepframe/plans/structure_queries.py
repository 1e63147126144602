"""Trees, graphs and kernels over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import micros
from ..operators import graphs as G
from ..operators import kernels as K
from ..operators import trees as T
from ..operators import weighted as W
from .catalogue_queries import BY_FILE, by_file
from .registry import Registry, table

R = Registry()

TREE_SQL = """nodes AS (SELECT r_name AS tree, 'r' AS node, NULL AS parent, 0.0::DOUBLE AS length FROM region
 UNION ALL SELECT r_name, 'n' || n_nationkey, 'r', 1.0::DOUBLE FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, 'c' || c_custkey, 'n' || c_nationkey, 1.0 + (c_custkey % 5)::DOUBLE FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT r_name, 'o' || o_orderkey, 'c' || o_custkey, 1.0 + (o_orderkey % 3)::DOUBLE FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _tree(spark, d) -> DataFrame:
    """One tree per region: region, nations, customers, orders."""
    region, nation, customer, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    c = customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = orders.join(c, F.col("o_custkey") == F.col("c_custkey"))

    def rows(df, node, parent, length):
        return df.select(F.col("r_name").alias("tree"), node.alias("node"), parent.alias("parent"), length.cast("double").alias("length"))

    name = lambda p, c: F.concat(F.lit(p), F.col(c))
    parts = [rows(region, F.lit("r"), F.lit(None).cast("string"), F.lit(0)), rows(n, name("n", "n_nationkey"), F.lit("r"), F.lit(1)), rows(c, name("c", "c_custkey"), name("n", "c_nationkey"), 1 + F.col("c_custkey") % 5), rows(o, name("o", "o_orderkey"), name("c", "o_custkey"), 1 + F.col("o_orderkey") % 3)]
    return reduce(DataFrame.unionByName, parts)


@R.query(f"""WITH RECURSIVE {TREE_SQL}, d AS (SELECT tree, node, 0::BIGINT AS depth, 0.0::DOUBLE AS height FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, d.depth + 1, d.height + n.length FROM d JOIN nodes n ON n.tree = d.tree AND n.parent = d.node) SELECT tree, node, depth, height FROM d""")
def tree_depth(spark, d):
    return T.depths(_tree(spark, d)).select("tree", "node", "depth", "height")


@R.query(f"""WITH RECURSIVE {TREE_SQL}, anc AS (SELECT tree, node AS tip, node, parent FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.tree = x.tree AND y.parent = x.node) UNION ALL SELECT a.tree, a.tip, n.node, n.parent FROM anc a JOIN nodes n ON n.tree = a.tree AND n.node = a.parent),
 tips AS (SELECT tree, node, any_value(parent) AS parent, count(*) AS tips, bool_or(tip = node) AS is_tip FROM anc GROUP BY tree, node),
 kids AS (SELECT tree, parent AS node, count(*) AS k, sum(is_tip::INT) AS kt, max(tips) - min(tips) AS diff FROM tips WHERE parent IS NOT NULL GROUP BY ALL),
 dep AS (SELECT tree, tip, count(*) - 1 AS depth FROM anc GROUP BY ALL), alld AS (SELECT tree, node, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, a.depth + 1 FROM alld a JOIN nodes n ON n.tree = a.tree AND n.parent = a.node)
SELECT t.tree, t.ntip, t.sackin, k.cherries, k.colless, c.cophenetic, w.width FROM (SELECT tree, count(*) AS ntip, sum(depth)::BIGINT AS sackin FROM dep GROUP BY ALL) t
 JOIN (SELECT tree, count(*) FILTER (k = 2 AND kt = 2) AS cherries, coalesce(sum(diff) FILTER (k = 2), 0)::BIGINT AS colless FROM kids GROUP BY ALL) k USING (tree)
 JOIN (SELECT tree, sum(tips * (tips - 1) // 2)::BIGINT AS cophenetic FROM tips WHERE parent IS NOT NULL AND NOT is_tip GROUP BY ALL) c USING (tree)
 JOIN (SELECT tree, max(n) AS width FROM (SELECT tree, depth, count(*) AS n FROM alld GROUP BY ALL) GROUP BY ALL) w USING (tree)""")
def tree_balance(spark, d):
    """Number of tips, Sackin, cherries, Colless, total cophenetic and width of each tree."""
    return T.balance(_tree(spark, d))


@R.query(f"""WITH RECURSIVE {TREE_SQL}, q AS (SELECT a.tree, a.node AS a, 'c' || (substr(a.node, 2)::BIGINT + 100) AS b FROM nodes a JOIN nodes b ON b.tree = a.tree AND b.node = 'c' || (substr(a.node, 2)::BIGINT + 100) WHERE a.node LIKE 'c%'),
 anc AS (SELECT tree, node AS tip, node, parent, 0.0::DOUBLE AS dist, length FROM nodes WHERE node LIKE 'c%' UNION ALL SELECT x.tree, x.tip, n.node, n.parent, x.dist + x.length, n.length FROM anc x JOIN nodes n ON n.tree = x.tree AND n.node = x.parent)
SELECT q.tree, q.a, q.b, min(x.dist + y.dist) AS distance FROM q JOIN anc x ON x.tree = q.tree AND x.tip = q.a JOIN anc y ON y.tree = q.tree AND y.tip = q.b AND y.node = x.node GROUP BY ALL""")
def patristic_distance(spark, d):
    """Distance along the tree between each customer and the one 100 numbers on, if in the same tree."""
    t = _tree(spark, d)
    c = t.where("node like 'c%'").select("tree", F.col("node").alias("a"))
    other = F.concat(F.lit("c"), F.substring("a", 2, 20).try_cast("bigint") + 100)
    q = c.withColumn("b", other).join(c.select("tree", F.col("a").alias("b")), ["tree", "b"])
    return T.patristic(t, q.select("tree", "a", "b"))


@R.query(f"WITH {TREE_SQL}, m AS (SELECT tree, avg(length) AS m FROM nodes WHERE parent IS NOT NULL GROUP BY ALL) SELECT tree, node, round(length / m, 8) AS length FROM nodes JOIN m USING (tree)")
def scaled_branches(spark, d):
    return T.scale_branches(_tree(spark, d)).select("tree", "node", F.round("length", 8).alias("length"))


@R.query(f"""WITH {TREE_SQL}, o AS (SELECT n.* FROM nodes n JOIN orders ON n.node = 'o' || o_orderkey WHERE o_orderstatus = 'P'), k AS (SELECT parent, count(*) AS k FROM o GROUP BY ALL), c AS (SELECT n.tree, n.node, n.parent, n.length FROM nodes n JOIN k ON n.node = k.parent WHERE k.k > 1), s AS (SELECT o.tree, o.node, n.parent, o.length + n.length AS length FROM o JOIN k USING (parent) JOIN nodes n ON n.node = o.parent AND n.tree = o.tree WHERE k.k = 1)
SELECT tree, count(*) AS n, round(sum(length), 4) AS total FROM (SELECT tree, node, length FROM c UNION ALL SELECT o.tree, o.node, o.length FROM o JOIN k USING (parent) WHERE k.k > 1 UNION ALL SELECT tree, node, length FROM s) GROUP BY ALL""")
def pruned_tree(spark, d):
    """The trees with only the pending orders as tips, summarised below the nations."""
    t = _tree(spark, d)
    keep = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    tips = t.join(t.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    p = T.prune(t, tips.join(keep, "node", "left_anti").select("tree", "node"))
    return p.where("node like 'c%' or node like 'o%'").groupBy("tree").agg(F.count("*").alias("n"), F.round(F.sum("length"), 4).alias("total"))


@R.query("""WITH e AS (SELECT event_type AS k, epoch_us(ts) AS t FROM events UNION ALL SELECT 'all', epoch_us(ts) FROM events), p AS (SELECT k, t, count(*) AS w FROM e GROUP BY ALL),
 c AS (SELECT k, (t - min(t) OVER (PARTITION BY k))::DOUBLE / (max(t) OVER (PARTITION BY k) - min(t) OVER (PARTITION BY k)) AS x, (sum(w) OVER (PARTITION BY k ORDER BY t))::DOUBLE / sum(w) OVER (PARTITION BY k) AS f FROM p),
 u AS (SELECT t.k, x, max(f) AS f, max(g) AS g FROM (SELECT k, x, f, NULL AS g FROM c WHERE k <> 'all' UNION ALL SELECT t.k, x, NULL, f FROM c, (SELECT DISTINCT k FROM c WHERE k <> 'all') t WHERE c.k = 'all') t GROUP BY ALL),
 v AS (SELECT k, x, coalesce(last_value(f IGNORE NULLS) OVER w, 0) AS f, coalesce(last_value(g IGNORE NULLS) OVER w, 0) AS g FROM u WINDOW w AS (PARTITION BY k ORDER BY x))
SELECT k AS event_type, round(sum((nx - x) * abs(f - g)), 8) AS distance FROM (SELECT *, lead(x) OVER (PARTITION BY k ORDER BY x) AS nx FROM v) WHERE nx IS NOT NULL GROUP BY ALL""")
def nltt_distance(spark, d):
    """Area between each event type's normalised curve through time and the curve of all events."""
    e = table(spark, d, "events")
    e = e.select("event_type", micros(e, "ts").alias("t"))
    one = T.lineages(e.withColumn("k", F.lit("all")), ["k"], F.col("t"))
    return T.step_distance(T.lineages(e, ["event_type"], F.col("t")), "event_type", one).withColumn("distance", F.round("distance", 8))


HEIGHTS = f"{TREE_SQL}, h AS (SELECT tree, node, parent, 0.0::DOUBLE AS height, 0 AS depth FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, n.parent, h.height + n.length, h.depth + 1 FROM h JOIN nodes n ON n.tree = h.tree AND n.parent = h.node)"


@R.query(f"""WITH RECURSIVE {HEIGHTS}, i AS (SELECT tree, round(height, 8) AS x, count(*) AS w FROM h WHERE EXISTS (SELECT 1 FROM nodes k WHERE k.tree = h.tree AND k.parent = h.node) GROUP BY ALL),
 c AS (SELECT tree, x / max(x) OVER g AS x, (sum(w) OVER (PARTITION BY tree ORDER BY x) - 1)::DOUBLE / (sum(w) OVER g - 1) AS f FROM i WINDOW g AS (PARTITION BY tree)),
 u AS (SELECT k AS tree, x, max(f) AS f, max(g) AS g FROM (SELECT tree AS k, x, f, NULL AS g FROM c UNION ALL SELECT t.k, x, NULL, f FROM c, (SELECT DISTINCT tree AS k FROM c) t WHERE c.tree = 'AFRICA') GROUP BY ALL),
 v AS (SELECT tree, x, coalesce(last_value(f IGNORE NULLS) OVER w, 0) AS f, coalesce(last_value(g IGNORE NULLS) OVER w, 0) AS g FROM u WINDOW w AS (PARTITION BY tree ORDER BY x))
SELECT tree, round(sum((nx - x) * abs(f - g)), 8) AS distance FROM (SELECT *, lead(x) OVER (PARTITION BY tree ORDER BY x) AS nx FROM v) WHERE nx IS NOT NULL GROUP BY ALL""")
def nltt_trees(spark, d):
    """Area between each tree's normalised lineages through time and those of one tree."""
    c = W.materialise(T.nltt_curves(_tree(spark, d)), "curves")
    out = T.step_distance(c, "tree", c.where("tree = 'AFRICA'").select("x", "f"))
    return out.select("tree", (F.round("distance", 8) + 0.0).alias("distance"))


@R.query(f"""WITH RECURSIVE {TREE_SQL}, anc AS (SELECT tree, node AS tip, node, parent, 0.0::DOUBLE AS dist, length FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.tree = x.tree AND y.parent = x.node) UNION ALL SELECT a.tree, a.tip, n.node, n.parent, a.dist + a.length, n.length FROM anc a JOIN nodes n ON n.tree = a.tree AND n.node = a.parent WHERE a.dist + a.length <= 3),
 e AS (SELECT DISTINCT a.tree, a.tip AS a, b.tip AS b FROM anc a JOIN anc b ON a.tree = b.tree AND a.node = b.node AND a.dist + b.dist <= 4), r AS (SELECT tree, a AS tip, a AS c FROM e UNION SELECT e.tree, e.b, r.c FROM r JOIN e ON e.tree = r.tree AND e.a = r.tip), k AS (SELECT tree, tip, min(c) AS c FROM r GROUP BY ALL), s AS (SELECT tree, c, count(*) AS n FROM k GROUP BY ALL)
SELECT tree, count(*) AS clusters, max(n) AS largest FROM s GROUP BY ALL""")
def tree_clusters(spark, d):
    """Clusters of the tips of each tree that are linked by distances of at most 4, and the size of the largest."""
    c = T.distance_clusters(_tree(spark, d), 4.0).groupBy("tree", "cluster").agg(F.count("*").alias("n"))
    return c.groupBy("tree").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


@R.query(f"""WITH RECURSIVE {HEIGHTS}, anc AS (SELECT tree, node AS tip, node, parent FROM nodes x WHERE NOT EXISTS (SELECT 1 FROM nodes y WHERE y.tree = x.tree AND y.parent = x.node) UNION ALL SELECT a.tree, a.tip, n.node, n.parent FROM anc a JOIN nodes n ON n.tree = a.tree AND n.node = a.parent),
 tips AS (SELECT tree, node, any_value(parent) AS parent, count(*) AS tips, bool_or(tip = node) AS is_tip FROM anc GROUP BY tree, node), kids AS (SELECT tree, parent AS node, count(*) AS k, sum(is_tip::INT) AS kt, max(tips) AS hi, min(tips) AS lo FROM tips WHERE parent IS NOT NULL GROUP BY ALL),
 il AS (SELECT kids.tree, kids.node, h.parent FROM kids JOIN h USING (tree, node) WHERE k > 1 AND kt = 1), run AS (SELECT tree, node, 1 AS n FROM il UNION ALL SELECT il.tree, il.node, run.n + 1 FROM run JOIN il ON il.tree = run.tree AND il.parent = run.node),
 w AS (SELECT tree, depth, count(*) AS n FROM h GROUP BY ALL), inn AS (SELECT h.tree, h.height, h.node, k - 1 AS more FROM kids JOIN h USING (tree, node)),
 g AS (SELECT tree, height, node, sum(more) OVER o AS lin, coalesce((sum(more) OVER o - more + 1) * (height - lag(height) OVER o), 0) AS a FROM inn WINDOW o AS (PARTITION BY tree ORDER BY height, node)),
 t AS (SELECT tree, height, lin, sum(a) OVER (PARTITION BY tree ORDER BY height, node) AS t FROM g), top AS (SELECT tree, max(height) AS top FROM h GROUP BY ALL), l AS (SELECT tree, count(*) - 1 AS m, sum(t) AS s, max(t) + (max(lin) + 1) * (max(top) - max(height)) AS tt FROM t JOIN top USING (tree) GROUP BY ALL)
SELECT tree, il_nodes, coalesce(max_ladder, 0) AS max_ladder, max_delta_width, round(pu, 8) AS prop_unbalanced, round(mb, 8) AS mean_balance, round(wd, 8) AS width_depth, round(itr, 8) AS int_tip_ratio, round((s / m - tt / 2) / (tt * sqrt(1 / (12.0 * m))), 6) AS gamma
FROM (SELECT tree, count(*) FILTER (k > 1 AND kt = 1) AS il_nodes, avg((hi <> lo)::INT) FILTER (k = 2) AS pu, avg(lo / hi) FILTER (k = 2) AS mb FROM kids GROUP BY ALL) LEFT JOIN (SELECT tree, max(n) AS max_ladder FROM run GROUP BY ALL) USING (tree)
 JOIN (SELECT tree, max(n) / max(depth) AS wd, max(dw) AS max_delta_width FROM (SELECT *, abs(n - lag(n) OVER (PARTITION BY tree ORDER BY depth)) AS dw FROM w) GROUP BY ALL) USING (tree)
 JOIN (SELECT n.tree, avg(length) FILTER (NOT is_tip) / avg(length) FILTER (is_tip) AS itr FROM nodes n JOIN tips USING (tree, node) WHERE n.parent IS NOT NULL GROUP BY ALL) USING (tree) JOIN l USING (tree)""")
def tree_shape(spark, d):
    """Ladders, balance of cherries, changes of width, branch ratio and gamma of each tree."""
    s = T.shape(_tree(spark, d))
    return s.select("tree", "il_nodes", "max_ladder", "max_delta_width", *[F.round(c, 8).alias(c) for c in ("prop_unbalanced", "mean_balance", "width_depth", "int_tip_ratio")], F.round("gamma", 6).alias("gamma"))


EDGES_SQL = f"{BY_FILE}, e AS (SELECT DISTINCT least(path, dep_path) AS a, greatest(path, dep_path) AS b FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL)"


def _edges(spark, d) -> DataFrame:
    return by_file(spark, d, "expt_dependencies").select(F.col("dep_path").alias("src"), F.col("path").alias("dst"))


@R.query(f"WITH {EDGES_SQL}, n AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY ALL) SELECT degree, count(*) AS n FROM n GROUP BY ALL")
def degree_distribution(spark, d):
    return G.degrees(_edges(spark, d)).groupBy("degree").agg(F.count("*").alias("n"))


@R.query(f"WITH {BY_FILE} SELECT src, dst, 1.0::DOUBLE AS transmit FROM (SELECT path AS src, dep_path AS dst FROM dep UNION SELECT dep_path, path FROM dep) WHERE src <> dst")
def mutual_edges(spark, d):
    return G.mutual(_edges(spark, d))


@R.query(f"WITH {EDGES_SQL}, n AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e WHERE a <> b UNION ALL SELECT b FROM e WHERE a <> b) GROUP BY ALL) SELECT node, (SELECT count(*) FROM n) - 1 - degree AS absent FROM n")
def complement_edges(spark, d):
    return G.complement_counts(_edges(spark, d))


@R.query(f"WITH RECURSIVE {EDGES_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS c FROM u UNION SELECT u.b, r.c FROM r JOIN u ON r.node = u.a) SELECT node, min(c) AS component FROM r GROUP BY ALL")
def connected_components(spark, d):
    return G.components(_edges(spark, d))


@R.query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS new FROM events), c AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), s AS (SELECT user_id, k, count(*) AS n FROM c GROUP BY ALL)
SELECT user_id, count(*) AS clusters, max(n) AS largest FROM s GROUP BY ALL""")
def threshold_clusters(spark, d):
    """Clusters of a user's events that are linked by gaps of six hours at most, and the size of the largest."""
    e = table(spark, d, "events")
    c = G.cluster_1d(e.select("user_id", "ts", "event_id", micros(e, "ts").alias("t")), ["user_id"], ["ts", "event_id"], F.col("t"), 21_600_000_000)
    return c.groupBy("user_id", "cluster").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


@R.query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(exp(-0.05 * list_sum(list_transform(list_zip(q.v, e.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS kernel FROM e q JOIN e ON true WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(kernel, 6) AS kernel, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY kernel DESC, id))::INTEGER AS rank FROM s) WHERE rank <= 10""")
def kernel_neighbours(spark, d):
    """The ten rows most similar by an RBF kernel to every row whose id is divisible by 100, among all rows."""
    e = table(spark, d, "embeddings")
    return K.nearest_by_kernel(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"), 0.05, 10).withColumn("kernel", F.round("kernel", 6))


@R.query()
def kernel_ridge_cv(spark, d):
    """Accuracy of kernel ridge classification of the labels, five folds by hash of the id."""
    return K.ridge_cv(table(spark, d, "embeddings"), "vec_id", "embedding", "label", F.pmod(F.xxhash64("vec_id"), F.lit(5)), 5, 0.05)


@R.query()
def kernel_pca(spark, d):
    return K.principal_components(table(spark, d, "embeddings"), "vec_id", "embedding", 0.05)


@R.query("""WITH p AS (SELECT l_returnflag, l_quantity AS x, sum(1.0 + l_tax) AS w, sum((1.0 + l_tax) * (1.0 + l_tax)) AS q FROM lineitem GROUP BY ALL), r AS (SELECT l_returnflag, x, pow(sum(w) OVER o, 2) / sum(q) OVER o AS ess, pow(sum(w) OVER g, 2) / sum(q) OVER g AS full_ess FROM p WINDOW o AS (PARTITION BY l_returnflag ORDER BY x), g AS (PARTITION BY l_returnflag))
SELECT l_returnflag, x AS epsilon, round(ess, 3) AS ess FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY x) AS k FROM r WHERE ess >= 0.9 * full_ess) WHERE k = 1""")
def smc_next_tolerance(spark, d):
    """Adaptive tolerance: quantities as distances, weights from taxes, 90 % of the effective sample size kept."""
    t = table(spark, d, "lineitem").withColumn("w", 1.0 + F.col("l_tax"))
    return W.next_tolerance(t, ["l_returnflag"], "l_quantity", "w", 0.9).withColumn("ess", F.round("ess", 3))


QUERIES, ORACLE = R.queries, R.oracle
