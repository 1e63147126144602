"""Given tables written in the formats of result files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import readers
from .registry import Registry, table

R = Registry()


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@R.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def tsv_round_trip(spark, d):
    path = _folder(spark, "orders")
    readers.write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path, "gzip")
    return readers.read_table(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").drop("path")


@R.query("""WITH c AS (SELECT n_nationkey + 1 AS i, (n_nationkey * 7) % 25 + 1 AS j, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), s AS (SELECT greatest(i, j) AS i, least(i, j) AS j, sum(n) AS v FROM c GROUP BY ALL), k AS (SELECT unnest(range(1, 26)) AS k)
SELECT a.k::BIGINT AS i, b.k::BIGINT AS j, coalesce(v, 0)::DOUBLE AS v FROM k a, k b LEFT JOIN s ON s.i = greatest(a.k, b.k) AND s.j = least(a.k, b.k)""")
def matrix_round_trip(spark, d):
    """Customers by nation and a partner nation as a symmetric matrix, absent cells 0, through a MatrixMarket array."""
    n = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 1).alias("i"), ((F.col("c_nationkey") * 7) % 25 + 1).alias("j")).agg(F.count("*").alias("n"))
    s = n.groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.sum("n").cast("double").alias("v"))
    path = _folder(spark, "matrix")
    readers.write_matrix(s.where("i is not null and j is not null"), path, size=25)
    whole = spark.read.text(path, wholetext=True)  # parts in order are the file
    one = _folder(spark, "whole")
    parts = whole.select(F.col("_metadata.file_path").alias("p"), "value").groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda e: e["value"]), "").alias("value"))
    parts.select(F.rtrim(F.col("value")).alias("value")).coalesce(1).write.text(one)
    return readers.read_matrix(spark, one).select("i", "j", "v")


@R.query("""SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 3 > 0 THEN p_size END AS t, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS seq FROM part""")
def fasta_round_trip(spark, d):
    t = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("t"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("seq"))
    path = _folder(spark, "fasta")
    readers.write_fasta(t, path)
    return readers.read_fasta(spark, path).drop("path")


@R.query("""SELECT r_name AS tree, n_name AS label, count(c_custkey)::BIGINT AS children, round(1.5 + n_nationkey, 6) AS length FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name, n_nationkey""")
def newick_round_trip(spark, d):
    """A tree of nations and customers per region, written as Newick and parsed back: the customers below each nation."""
    region, nation, customer = (table(spark, d, t) for t in ("region", "nation", "customer"))
    n = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None)
    root = region.select(F.col("r_name").alias("tree"), F.lit("a").alias("node"), none.cast("string").alias("parent"), none.cast("double").alias("length"), F.col("r_name").alias("label"))
    inner = n.select(F.col("r_name").alias("tree"), F.concat(F.lit("b"), "n_nationkey").alias("node"), F.lit("a").alias("parent"), (1.5 + F.col("n_nationkey")).alias("length"), F.col("n_name").alias("label"))
    tips = customer.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("tree"), F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("b"), "c_nationkey").alias("parent"), F.lit(1.0).alias("length"), F.col("c_name").alias("label"))
    parsed = readers.parse_newick(readers.newick_texts(root.union(inner).union(tips)), "tree", "text")
    kids = parsed.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    top = parsed.where("parent is null").select("tree", F.col("node").alias("parent"))
    nations = parsed.join(top, ["tree", "parent"]).join(kids, ["tree", "node"], "left")
    return nations.select("tree", "label", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), F.round("length", 6).alias("length"))


QUERIES, ORACLE = R.queries, R.oracle
