"""Parameter grids: domains, expansion, exclusions, intersections, prerequisite points. Grids are specifications, not data."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = re.compile(r"^range\(\s*(-?\d+)\s*(?:,\s*(-?\d+)\s*)?(?:,\s*(-?\d+)\s*)?\)$")
SCALED = re.compile(r"^\[\s*i\s*/\s*(\d+(?:\.\d+)?)\s+for\s+i\s+in\s+(range\([^)]*\))\s*\]$")


def domain(value) -> list[str]:
    """The values of a domain as sorted distinct text: a scalar, a list, 'range(a, b, c)' or '[i/k for i in range(n)]'.

    Only these two expressions are understood; any other text is a plain value and is never evaluated.
    """
    if isinstance(value, str) and (m := RANGE.match(value.strip())):
        a, b, c = (int(x) if x is not None else None for x in m.groups())
        values: list = list(range(a) if b is None else range(a, b, c or 1))
    elif isinstance(value, str) and (m := SCALED.match(value.strip())):
        values = [int(v) / float(m[1]) for v in domain(m[2])]
    else:
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
    numeric = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
    return [str(v) for v in (sorted(set(values)) if numeric else sorted({str(v) for v in values}))]


def expand(spark: SparkSession, domains: Mapping[str, object], exclusions: list[Mapping[str, object]] = ()) -> DataFrame:
    """One row per point, a text column per parameter, by one explode per parameter. An exclusion drops the points that
    are in it for all of its keys; one with a key that the grid lacks never fires. No parameters give one empty point."""
    df = spark.range(1).select()
    df = spark.createDataFrame([(0,)], "_one int")
    for name in sorted(domains):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in domain(domains[name])]).cast("array<string>")))
    for e in exclusions:
        if e and all(k in domains for k in e):
            hit = F.lit(True)
            for k, v in e.items():
                hit = hit & F.col(k).isin(domain(v))
            df = df.where(~hit)
    return df.drop("_one")


def intersect(a: Mapping[str, object], b: Mapping[str, object]) -> dict[str, list[str]]:
    """Domains of the shared parameters, empty ones left out."""
    both = {k: [v for v in domain(a[k]) if v in set(domain(b[k]))] for k in a if k in b}
    return {k: v for k, v in both.items() if v}


def restrict(a: Mapping[str, object], b: Mapping[str, object]) -> dict[str, list[str]]:
    """a with the shared parameters narrowed to b; the others untouched."""
    return {k: [v for v in domain(a[k]) if k not in b or v in set(domain(b[k]))] for k in a}


def prerequisites(target: DataFrame, dependency: DataFrame) -> DataFrame:
    """Each target point with the dependency points that agree on the shared parameters: an equi-join on those.

    Without a shared parameter every target needs every point; that is refused unless one side is a single point.
    """
    shared = [c for c in target.columns if c in dependency.columns]
    if not shared:
        if dependency.limit(2).count() > 1 and target.limit(2).count() > 1:
            raise ValueError("no shared parameter between grids of several points each")
        return target.withColumn("_j", F.lit(1)).join(dependency.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return target.join(dependency, shared)


def seed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add seed in [0, 2^31), derived from the point, so reruns repeat it."""
    return df.withColumn("seed", F.pmod(F.xxhash64(*columns), F.lit(1 << 31)))


def render(template: str, point: Mapping[str, object]) -> str:
    """A rule text with {name} filled in; doubled braces stand for themselves."""
    return template.format(**point)


def seconds(walltime: str) -> int:
    """h:m:s to seconds."""
    h, m, s = (int(x) for x in walltime.split(":"))
    return (h * 60 + m) * 60 + s
