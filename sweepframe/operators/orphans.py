"""References to records that do not exist, are deleted or arrive later.

Method: a broadcast Bloom filter of the parent keys proves definite orphans; only the references it lets through are
checked by an exact join with one summary row per parent, and the few that the summary cannot decide (parents stored and
purged several times) by a running count along the parent's timeline. Counts per table and period come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import bloom
from .ordered import CHUNK_ROWS, running_sum


def references(df: DataFrame, id_col: str, fields: list[str], at: str, key_of) -> DataFrame:
    """(id, ref_field, key, at): one row per non-null reference with a time, repeated rows once."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("_ref")) for f in fields]))
    rows = df.where(F.col(at).isNotNull()).select(F.col(id_col).alias("id"), F.col(at).alias("at"), each.alias("r"))
    return rows.where("r._ref is not null").select("id", "r.ref_field", key_of(F.col("r._ref")).alias("key"), "at")


def orphans(refs: DataFrame, parents: DataFrame, key: Column, stored: str, purged: str, target: int = CHUNK_ROWS) -> DataFrame:
    """(id, ref_field, kind, at) of each reference that does not hold at its time, distinct rows.

    refs: (id, ref_field, key, at). parents: rows with a key, stored and purged times. kind: missing (no parent row of that
    key), late (every row is stored after at, or at no known time), deleted (rows stored by then, each purged by then). A row whose
    purged time is null was never purged. Parent rows with a null key are no parents; an empty parent table makes every
    reference missing. One key may hold any share of either side: parents are summarised before the join, the timeline
    is cut into chunks of about target rows.
    """
    refs = refs.distinct()
    parents = parents.select(key.alias("key"), F.col(stored).alias("stored"), F.col(purged).alias("purged")).where("key is not null")
    seen = bloom.build(parents, F.col("key"), parents.count())
    probed = materialise(refs.withColumn("_maybe", bloom.might_contain(F.col("key"), seen)), "probed")  # read and probed once
    definite = probed.where(~F.col("_maybe")).select("id", "ref_field", F.lit("missing").alias("kind"), "at")

    gone = F.greatest("stored", "purged")
    one = parents.groupBy("key").agg(
        F.min("stored").alias("first"), F.min(F.when(F.col("purged").isNull(), F.col("stored"))).alias("open"),
        F.max(F.when(F.col("purged").isNotNull(), gone)).alias("last_gone"), F.min(F.when(F.col("purged").isNotNull() & F.col("stored").isNotNull(), gone)).alias("first_gone"), F.count("*").alias("n"),
    )
    p = probed.where("_maybe").join(one, "key", "left")
    kind = (
        F.when(F.col("n").isNull(), "missing")
        .when(F.col("first").isNull() | (F.col("first") > F.col("at")), "late")
        .when(F.col("open") <= F.col("at"), "holds")
        .when(F.col("last_gone") <= F.col("at"), "deleted")
        .when(F.col("first_gone") > F.col("at"), "holds")
        .otherwise("undecided")
    )
    checked = materialise(p.withColumn("kind", kind).where("kind <> 'holds'").select("id", "ref_field", "key", "at", "kind"), "orphans")  # few: what holds is gone
    decided = checked.where("kind <> 'undecided'").select("id", "ref_field", "kind", "at")

    open_refs = checked.where("kind = 'undecided'").select("key", "at", F.lit(1).alias("_order"), F.lit(0).alias("_step"), "id", "ref_field")
    none = [F.lit(None).cast(refs.schema["id"].dataType).alias("id"), F.lit(None).cast("string").alias("ref_field")]
    wanted = parents.join(open_refs.select("key").distinct(), "key", "left_semi").where("stored is not null")
    events = wanted.select("key", F.explode(F.array(F.struct(F.col("stored").alias("at"), F.lit(1).alias("_step")), F.struct(F.when(F.col("purged").isNotNull(), gone).alias("at"), F.lit(-1).alias("_step")))).alias("e"))
    events = events.where("e.at is not null").select("key", "e.at", F.lit(0).alias("_order"), "e._step", *none)
    timeline = running_sum(events.unionByName(open_refs), ["key"], ["at", "_order", "id", "ref_field"], {"_live": F.col("_step")}, target)
    late_check = timeline.where("_order = 1 and _live <= 0").select("id", "ref_field", F.lit("deleted").alias("kind"), "at")
    return definite.unionByName(decided).unionByName(late_check)
