"""Sampling by keys derived from ids: repeatable, and the same however the data is partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import running_sum


def half_split(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """Add half (0 or 1): exactly half of the rows (rounded down) are 0, chosen by a hash order of the id; ids must be unique."""
    ranked = running_sum(df.withColumns({"_all": F.lit(0), "_h": F.xxhash64(id_col, F.lit(seed))}), ["_all"], ["_h", id_col], {"_r": F.lit(1)})
    return ranked.withColumn("half", F.when(F.col("_r") <= df.count() // 2, 0).otherwise(1)).drop("_all", "_h", "_r")


def weighted_sample(df: DataFrame, keys: list[str], id_col: str, weight: str, m: int, seed: int = 0) -> DataFrame:
    """m rows per group without replacement, chances by weight (keys -ln(u) / w, the m smallest); all rows of smaller groups.

    u is derived from the id. The threshold of a group is the m-th smallest key, found by running counts; rows without a
    positive weight are never drawn.
    """
    u = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = df.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight))
    return running_sum(drawn, keys, ["_k", id_col], {"_r": F.lit(1)}).where(F.col("_r") <= m).drop("_k", "_r")
