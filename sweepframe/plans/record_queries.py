"""Queries p1 to p6: the record-cleaning operators over their tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import file_key
from ..operators import eav, intervals, nested, orphans, schema_drift, timestamps
from ..session import bounded_rows

SERIES, ORDER = ["experiment", "step"], ["written_at", "file_id"]
#: Qualifier names, apart from case, blanks, '_' and '-', that hold dates.
DATE_QUALIFIERS = ("collectiondate", "receiptdate", "sequencingdate")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _kinds(types: DataFrame) -> dict[str, str]:
    rows = bounded_rows(types.select("parameter", "value_type").where("parameter is not null and value_type is not null"))
    if rows is None:
        raise ValueError("parameter_types must be a small dimension table")
    return {r.parameter: r.value_type for r in sorted(rows)}


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "parameter_types"), table(spark, d, "parameter_aliases")


def _headers(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "trace_files").select("file_id", *SERIES, "path", "written_at", "yaml")
    return schema_drift.tagged_headers(files, "yaml", *_names(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "trace_files").select("file_id", *SERIES, "path", "written_at")
    rows = schema_drift.tagged_rows(files, table(spark, d, "expt_data"), *_names(spark, d))
    out = [schema_drift.changes(t, SERIES, ORDER, "file_id").select("file_id", F.lit(o).alias("origin"), "parameter", "change") for t, o in ((_headers(spark, d), "yaml"), (rows, "data"))]
    return out[0].unionByName(out[1])


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, path, written_at, origin, reading, fields): the headers of all files and the catalogue's rows of all paths,
    with or without a file."""
    headers = schema_drift.header_readings(_headers(spark, d)).select("file_id", "path", "written_at", F.lit("yaml").alias("origin"), "reading", "fields")
    files = table(spark, d, "trace_files").select("file_id", "path", "written_at")
    rows = schema_drift.tagged_values(table(spark, d, "expt_data"), *_names(spark, d)).join(files, "path", "left")
    return headers.unionByName(rows.select("file_id", "path", "written_at", F.lit("data").alias("origin"), "reading", "fields"))


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """All headers and catalogue rows in one table: typed columns and typed branches for values of other types."""
    return schema_drift.unified(_fused(spark, d), _kinds(table(spark, d, "parameter_types")), ["file_id", "path", "origin", "reading"], F.col("origin") == "yaml")


def p1_alternatives(spark: SparkSession, d: str) -> DataFrame:
    """Every type of every parameter: in how many files, in which first (by written_at) and when."""
    return schema_drift.alternatives(_fused(spark, d), "path", "written_at")


def _wide(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    types, aliases = _names(spark, d)
    kinds = _kinds(types)
    return *eav.widen(eav.distinct_cells(eav.typed_cells(table(spark, d, "expt_data"), types, aliases)), kinds), kinds


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    wide, others, kinds = _wide(spark, d)
    return eav.narrow(wide, others, kinds).withColumnRenamed("entity", "path")


def p2_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per path with a typed column per parameter; more names the parameters of which the path has further values."""
    return _wide(spark, d)[0].withColumnRenamed("entity", "path").drop("ordinal")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.references(table(spark, d, "expt_dependencies"), "link_id", ["path", "dep_path"], "recorded_at", file_key)
    found = orphans.orphans(refs, table(spark, d, "expt_md5"), file_key(F.col("path")), "stored_at", "purged_at")
    return found.select(F.col("id").alias("link_id"), "ref_field", "kind", F.date_format("at", "yyyy-MM").alias("period"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per referring field, month and kind."""
    return _orphans(spark, d).distinct().groupBy("ref_field", "period", "kind").agg(F.count("*").alias("n_links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, d, "gene_intervals"), "gbid", "start", "end")


def _date_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    keep = ["record_id", "gbid", "pmid", "lab_zone", "fetched_at"]
    quals = nested.qualifiers(nested.node_table(table(spark, d, "genbank_records").select(*keep, "record"), "record", keep), *keep)
    return quals.where(F.lower(F.regexp_replace("name", r"(?U)[\s_\-]+", "")).isin(*DATE_QUALIFIERS))


DATE_KEYS, DATE_GROUPS = ["record_id", "feature_no", "qual_no"], {"gbid": "sequence", "pmid": "study"}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_dates whose zone is written or declared, or that need none."""
    return timestamps.normalise(_date_qualifiers(spark, d), "value", "lab_zone", DATE_KEYS)


def _zoned(spark: SparkSession, d: str, by: Callable[..., DataFrame]) -> DataFrame:
    """Candidates are the zones that the table declares (a small dimension)."""
    records = table(spark, d, "genbank_records").select("gbid", "pmid", "lab_zone")
    zones = bounded_rows(records.select(timestamps.known_zone(spark, F.trim("lab_zone")).alias("zone")).where("zone is not null").distinct(), 1_000)
    if zones is None:
        raise ValueError("more than 1,000 declared zones")
    return by(_date_qualifiers(spark, d), records, DATE_KEYS, DATE_GROUPS, "value", "lab_zone", "fetched_at", sorted(z.zone for z in zones))


def p5_dates(spark: SparkSession, d: str) -> DataFrame:
    """Every readable date qualifier in one form, times without any zone included: converted by the estimated zone or, where
    that abstains, with normal null."""
    return _zoned(spark, d, timestamps.resolve)


def p5_zone_estimates(spark: SparkSession, d: str) -> DataFrame:
    """The times without any zone, converted by the zone estimated from the deliveries of their sequence, else from their study."""
    return _zoned(spark, d, timestamps.estimate_zones)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "genbank_records").select("record_id", "record")
    return nested.flat_items(nested.node_table(records, "record", ["record_id"]), "record_id")


def p6_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "genbank_records").select("record_id", "record")
    return nested.qualifiers(nested.node_table(records, "record", ["record_id"]), "record_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p1_alternatives, p2_found, p2_wide, p3_found, p3_report, p4_found, p5_found, p5_dates, p5_zone_estimates, p6_found, p6_qualifiers)}

_KEY = r"lower(regexp_replace({0}, '[\s_.\-]+', '', 'g'))"
_FILE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '[/\\]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '/(\.)?$', '')"
_ORPHANS = f"""r AS (SELECT DISTINCT link_id, ref_field, {_FILE.format('ref')} AS k, recorded_at FROM (SELECT link_id, 'path' AS ref_field, path AS ref, recorded_at FROM expt_dependencies UNION ALL SELECT link_id, 'dep_path', dep_path, recorded_at FROM expt_dependencies) WHERE ref IS NOT NULL AND recorded_at IS NOT NULL),
 m AS (SELECT {_FILE.format('path')} AS k, stored_at, purged_at FROM expt_md5 WHERE path IS NOT NULL),
 j AS (SELECT link_id, ref_field, recorded_at, count(m.k) AS n, count(*) FILTER (stored_at <= recorded_at) AS stored, count(*) FILTER (stored_at <= recorded_at AND (purged_at IS NULL OR purged_at > recorded_at)) AS live FROM r LEFT JOIN m USING (k) GROUP BY link_id, ref_field, r.k, recorded_at),
 o AS (SELECT DISTINCT link_id, ref_field, CASE WHEN n = 0 THEN 'missing' WHEN stored = 0 THEN 'late' ELSE 'deleted' END AS kind, strftime(recorded_at, '%Y-%m') AS period FROM j WHERE live = 0)"""

ORACLE = {
    "p2_found": f"""WITH names AS (SELECT {_KEY.format('parameter')} AS k, parameter, value_type FROM parameter_types UNION SELECT {_KEY.format('alias')}, t.parameter, value_type FROM parameter_aliases a JOIN parameter_types t ON a.parameter = t.parameter),
 d AS (SELECT path, n.parameter, value_type, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS v FROM expt_data e JOIN names n ON n.k = {_KEY.format('e.parameter')} WHERE path IS NOT NULL AND trim(path) <> ''),
 x AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d*)?') THEN replace(v, ',', '') ELSE v END AS n FROM d), y AS (SELECT *, CASE WHEN regexp_full_match(n, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN n::DOUBLE END AS num FROM x),
 c AS (SELECT path, parameter, CASE value_type WHEN 'integer' THEN CASE WHEN num = floor(num) THEN num::BIGINT::VARCHAR END WHEN 'double' THEN printf('%.6f', num) WHEN 'boolean' THEN CASE WHEN lower(v) IN ('true', 'yes', 't', 'y', 'on', '1') THEN 'true' WHEN lower(v) IN ('false', 'no', 'f', 'n', 'off', '0') THEN 'false' END
   WHEN 'text' THEN CASE WHEN lower(v) NOT IN ('na', 'none', 'null', 'nan', '') THEN v END END AS cell FROM y) SELECT DISTINCT path, parameter, cell FROM c WHERE cell IS NOT NULL""",
    "p3_found": f"WITH {_ORPHANS} SELECT link_id, ref_field, kind, period FROM o",
    "p3_report": f"WITH {_ORPHANS} SELECT ref_field, period, kind, count(*) AS n_links FROM o GROUP BY ALL",
    "p4_found": """WITH i AS (SELECT gbid, least(start, "end")::BIGINT AS s, greatest(start, "end")::BIGINT AS e FROM gene_intervals WHERE start IS NOT NULL AND "end" IS NOT NULL),
 m AS (SELECT *, max(e) OVER (PARTITION BY gbid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
 g AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gbid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
 r AS (SELECT gbid, k, min(s) AS a, max(e) AS b, lag(max(e)) OVER (PARTITION BY gbid ORDER BY k) AS before FROM g GROUP BY gbid, k)
SELECT gbid, 'period' AS kind, a AS range_start, b AS range_end FROM r UNION ALL SELECT gbid, 'gap', before + 1, a - 1 FROM r WHERE before IS NOT NULL""",
}
