"""Canonical spellings: parameter names and file paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_rows


def strip(c: Column) -> Column:
    """Without surrounding blanks of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    """Equal for spellings that differ only by case, blanks, '_', '-' and '.'."""
    return F.lower(F.regexp_replace(c, r"(?U)[\s_.\-]+", ""))


def canonical_names(types: DataFrame, aliases: DataFrame) -> Column | None:
    """A map literal from name_key to the name in types, through aliases; None if the tables are not small."""
    names, other = bounded_rows(types.select("parameter")), bounded_rows(aliases.select("alias", "parameter"))
    if names is None or other is None:
        return None

    def key(s: str) -> str:
        return "".join(ch for ch in s if not ch.isspace() and ch not in "_.-").lower()

    table = {key(r.parameter): r.parameter for r in names if r.parameter is not None}
    for r in other:
        if r.alias is not None and r.parameter is not None and key(r.parameter) in table:
            table.setdefault(key(r.alias), table[key(r.parameter)])
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map(F.lit(""), F.lit(None).cast("string"))


def with_parameter(df: DataFrame, spelled: str, types: DataFrame, aliases: DataFrame, out: str = "_parameter") -> DataFrame:
    """Add the canonical name of the spelling, null if it is unknown. Small name tables become a literal map."""
    table = canonical_names(types, aliases)
    if table is not None:
        return df.withColumn(out, table[name_key(F.col(spelled))])
    own = types.select(name_key(F.col("parameter")).alias("_k"), F.col("parameter").alias(out))
    more = aliases.select(name_key(F.col("alias")).alias("_k"), name_key(F.col("parameter")).alias("_p"))
    more = more.join(own.withColumnRenamed("_k", "_p"), "_p").select("_k", out)
    names = own.unionByName(more.join(own, "_k", "left_anti")).groupBy("_k").agg(F.min(out).alias(out))
    return df.withColumn("_k", name_key(F.col(spelled))).join(names, "_k", "left").drop("_k")


def file_key(path: Column) -> Column:
    """The file that a path names: without surrounding blanks, with '/' for any run of slashes, '.' and '..' resolved.

    A leading slash stays; '..' above the first segment is dropped; an empty path is the empty key. Case matters.
    """
    p = F.regexp_replace(strip(path), r"[/\\]+", "/")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    root = F.when(p.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    dotted = p.rlike(r"(^|/)\.{1,2}(/|$)") | p.endswith("/")
    return F.when(dotted, F.concat(root, F.array_join(F.when(p.rlike(r"(^|/)\.\.(/|$)"), up).otherwise(parts), "/"))).otherwise(p)
