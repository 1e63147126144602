"""Catalogue and grid queries over the experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogue as C
from ..operators import grid as G
from ..functions.names import file_key
from ..operators import eav
from .record_queries import _FILE, ORACLE as RECORDS
from .registry import Registry, table

R = Registry()


# The catalogue's tables with the file that each path names, and the typed cells of each file under canonical names.
BY_FILE = f"""md AS (SELECT * REPLACE ({_FILE.format('path')} AS path) FROM expt_md5), dat AS (SELECT * REPLACE ({_FILE.format('path')} AS path) FROM expt_data), fil AS (SELECT * REPLACE ({_FILE.format('path')} AS path) FROM trace_files),
 dep AS (SELECT * REPLACE ({_FILE.format('path')} AS path, {_FILE.format('dep_path')} AS dep_path) FROM expt_dependencies)"""
CELLS = f"{BY_FILE}, cells AS (SELECT DISTINCT {_FILE.format('path')} AS path, parameter, cell FROM ({RECORDS['p2_found']}))"


def by_file(spark, d, name):
    """A table of the catalogue with its paths as the files they name."""
    t = table(spark, d, name)
    return t.withColumns({c: file_key(F.col(c)) for c in ("path", "dep_path") if c in t.columns})


def cells(spark, d):
    """(path, parameter, cell): the typed cells of each file, whatever spelling and notation they are stored in."""
    typed = eav.typed_cells(table(spark, d, "expt_data"), table(spark, d, "parameter_types"), table(spark, d, "parameter_aliases"))
    return typed.select(file_key(F.col("entity")).alias("path"), "parameter", "cell").distinct()


@R.query(f"WITH {CELLS} SELECT path FROM cells WHERE path IN (SELECT path FROM dat WHERE step = 'network') AND ((parameter = 'net_type' AND cell = 'er') OR (parameter = 'm' AND cell = '5')) GROUP BY path HAVING count(DISTINCT parameter) = 2")
def eav_find(spark, d):
    steps = by_file(spark, d, "expt_data").select("path", "step").distinct()
    return C.find_all(cells(spark, d).join(steps, "path").withColumnRenamed("cell", "value"), "network", {"net_type": "er", "m": "5"})


@R.query(f"WITH {CELLS} SELECT DISTINCT path FROM cells WHERE path IN (SELECT path FROM dat WHERE step = 'tree') AND parameter = 'ntip' AND cell = '500'")
def cross_experiment_lookup(spark, d):
    trees = by_file(spark, d, "expt_data").where("step = 'tree'").select("path")
    return cells(spark, d).where("parameter = 'ntip' and cell = '500'").join(trees, "path", "left_semi").select("path").distinct()


@R.query("""SELECT step, path, parameter, value, stored_at FROM (SELECT *, row_number() OVER (PARTITION BY step, path, parameter ORDER BY stored_at DESC, value DESC NULLS LAST) AS k FROM expt_data) WHERE k = 1""")
def upsert_parameters(spark, d):
    t = table(spark, d, "expt_data")
    return C.upsert(t.where("stored_at < timestamp_ntz'2015-06-01'"), t.where("stored_at >= timestamp_ntz'2015-06-01' or stored_at is null"), ["step", "path", "parameter"], "stored_at")


@R.query(f"WITH {BY_FILE} SELECT path, max(checksum) FILTER (stored_at = top) AS checksum, max(stored_at) AS stored_at FROM (SELECT *, max(stored_at) OVER (PARTITION BY path) AS top FROM md) GROUP BY path")
def upsert_checksums(spark, d):
    """The checksums stored from 2015-06 on over the earlier ones, one row per file."""
    t = by_file(spark, d, "expt_md5").select("path", "checksum", "stored_at")
    late = F.coalesce(F.col("stored_at") >= F.expr("timestamp_ntz'2015-06-01'"), F.lit(True))
    return C.upsert(t.where(~late), t.where(late), ["path"], "stored_at")


@R.query(f"""WITH {BY_FILE}, m AS (SELECT path, max(checksum) AS checksum FROM md WHERE path IS NOT NULL GROUP BY path), l AS (SELECT DISTINCT path, dep_path, dep_checksum FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL),
 s AS (SELECT l.path, split_part(dep_path, '/', 2) AS step, count(*) AS n, count(*) FILTER (checksum IS NULL OR dep_checksum IS NULL OR checksum <> dep_checksum) AS bad, count(checksum) AS files FROM l LEFT JOIN m ON m.path = l.dep_path GROUP BY ALL)
SELECT path, sum(n)::BIGINT AS n_deps, sum(bad)::BIGINT AS n_stale, min(files) > 0 AS runnable FROM s GROUP BY ALL HAVING n_stale > 0""")
def stale_targets(spark, d):
    m = by_file(spark, d, "expt_md5").groupBy("path").agg(F.max("checksum").alias("checksum"))
    return C.stale(m, by_file(spark, d, "expt_dependencies"), F.coalesce(F.get(F.split("dep_path", "/"), F.lit(1)), F.lit("")))


@R.query(f"""WITH {BY_FILE}, l AS (SELECT DISTINCT path, dep_path FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL), m AS (SELECT path, max(checksum) FILTER (stored_at = top) AS checksum FROM (SELECT *, max(stored_at) OVER (PARTITION BY path) AS top FROM md) GROUP BY path)
SELECT l.path, l.dep_path, checksum FROM l LEFT JOIN m ON m.path = l.dep_path""")
def lineage_checksums(spark, d):
    """Every link of the lineage with the dependency's newest checksum."""
    return C.with_checksums(by_file(spark, d, "expt_dependencies"), by_file(spark, d, "expt_md5"), "stored_at")


@R.query(f"""WITH {BY_FILE}, x AS (SELECT DISTINCT path FROM md WHERE purged_at IS NOT NULL AND path IS NOT NULL)
SELECT 'expt_md5' AS name, count(*) AS n FROM md WHERE path IS NULL OR path NOT IN (SELECT path FROM x) UNION ALL SELECT 'expt_data', count(*) FROM dat WHERE path IS NULL OR path NOT IN (SELECT path FROM x)
UNION ALL SELECT 'expt_dependencies', count(*) FROM dep WHERE (path IS NULL OR path NOT IN (SELECT path FROM x)) AND (dep_path IS NULL OR dep_path NOT IN (SELECT path FROM x))""")
def purged_catalogue(spark, d):
    """The rows that stay in each table of the catalogue when the purged files are deleted from all of them."""
    doomed = by_file(spark, d, "expt_md5").where("purged_at is not null").select("path")
    kept = [C.delete_files(by_file(spark, d, n), doomed, c).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, c in (("expt_md5", ["path"]), ("expt_data", ["path"]), ("expt_dependencies", ["path", "dep_path"]))]
    return kept[0].union(kept[1]).union(kept[2])


@R.query(f"""WITH RECURSIVE {BY_FILE}, e AS (SELECT DISTINCT dep_path AS src, path AS dst FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL),
 seeds AS (SELECT DISTINCT path AS node FROM md WHERE purged_at IS NOT NULL AND path IS NOT NULL),
 r AS (SELECT node FROM seeds UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node AS path FROM r""")
def purge_closure(spark, d):
    """Everything that must go with the purged files: their transitive dependants."""
    seeds = by_file(spark, d, "expt_md5").where("purged_at is not null").select(F.col("path").alias("node"))
    return C.closure(by_file(spark, d, "expt_dependencies").select(F.col("dep_path").alias("src"), F.col("path").alias("dst")), seeds).select(F.col("node").alias("path"))


@R.query(f"""WITH RECURSIVE {BY_FILE}, e AS (SELECT DISTINCT split_part(dep_path, '/', 2) AS src, split_part(path, '/', 2) AS dst FROM dep WHERE split_part(path, '/', 3) <> '' AND split_part(dep_path, '/', 3) <> ''),
 n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r AS (SELECT node, 0 AS level FROM n WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON r.node = e.src) SELECT node AS step, max(level)::INTEGER AS level FROM r GROUP BY ALL""")
def topological_levels(spark, d):
    """Steps in dependency order; the step of a file is the second part of the path that names it."""
    p, q = F.split("path", "/"), F.split("dep_path", "/")
    edges = by_file(spark, d, "expt_dependencies").where((F.size(p) > 2) & (F.size(q) > 2)).select(q[1].alias("src"), p[1].alias("dst")).distinct()
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return C.levels(nodes, edges).withColumnRenamed("node", "step")


@R.query("(SELECT path FROM expt_md5 UNION SELECT path FROM expt_data UNION SELECT path FROM expt_dependencies)")
def catalogue_paths(spark, d):
    return table(spark, d, "expt_md5").select("path").union(table(spark, d, "expt_data").select("path")).union(table(spark, d, "expt_dependencies").select("path")).distinct()


@R.query(f"WITH {BY_FILE} ((SELECT path FROM md EXCEPT SELECT path FROM dat) UNION (SELECT path FROM dat EXCEPT SELECT path FROM md) UNION (SELECT path FROM dep EXCEPT SELECT path FROM md EXCEPT SELECT path FROM dat))")
def inconsistent_paths(spark, d):
    """Files that the three tables of the catalogue do not agree on."""
    m, e, x = (by_file(spark, d, t).select("path").distinct() for t in ("expt_md5", "expt_data", "expt_dependencies"))
    return m.subtract(e).union(e.subtract(m)).union(x.subtract(m).subtract(e)).distinct()


@R.query(f"WITH {BY_FILE} SELECT file_id, t.path FROM fil t WHERE NOT EXISTS (SELECT 1 FROM md m WHERE m.path = t.path)")
def unregistered_files(spark, d):
    return by_file(spark, d, "trace_files").join(by_file(spark, d, "expt_md5").select("path"), "path", "left_anti").select("file_id", "path")


@R.query(f"WITH {BY_FILE} SELECT DISTINCT t.path, t.experiment FROM fil t JOIN (SELECT DISTINCT path FROM dat EXCEPT SELECT path FROM md WHERE purged_at IS NULL) x ON t.path = x.path")
def orphan_parameters(spark, d):
    """Files with parameters of which no live checksum is left."""
    live = by_file(spark, d, "expt_md5").where("purged_at is null").select("path")
    rest = by_file(spark, d, "expt_data").select("path").where("path is not null").distinct().join(live, "path", "left_anti")
    return by_file(spark, d, "trace_files").join(rest, "path", "left_semi").select("path", "experiment").distinct()


@R.query(f"""WITH {CELLS}, own AS (SELECT step, path, list_sort(list(DISTINCT parameter)) AS own FROM cells JOIN (SELECT DISTINCT path, step FROM fil) f USING (path) GROUP BY ALL),
 c AS (SELECT step, own, count(*) AS n FROM own GROUP BY ALL), k AS (SELECT step, own AS keys FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, own) AS r FROM c) WHERE r = 1)
SELECT step, path, len(list_filter(keys, lambda x: NOT list_contains(own, x)))::INTEGER AS n_missing, len(list_filter(own, lambda x: NOT list_contains(keys, x)))::INTEGER AS n_extra FROM own JOIN k USING (step) WHERE own <> keys""")
def grid_mismatches(spark, d):
    """Files whose parameters are not those of their step's grid."""
    steps = by_file(spark, d, "trace_files").select("path", "step").distinct()
    return C.grid_mismatches(cells(spark, d).join(steps, "path"))


@R.query(f"WITH {CELLS} SELECT path, md5(string_agg(parameter || '=' || cell, chr(10) ORDER BY parameter || '=' || cell)) AS name FROM cells GROUP BY path")
def point_names(spark, d):
    """A name for the parameters of every file: equal for equal points, in whatever order and notation they are stored."""
    return C.canonical_point(cells(spark, d))


@R.query("SELECT file_id, md5(experiment || '/' || step || '/' || path) AS name FROM trace_files")
def content_names(spark, d):
    return table(spark, d, "trace_files").select("file_id", F.md5(F.concat_ws("/", "experiment", "step", "path")).alias("name"))


@R.query(f"WITH {BY_FILE} SELECT path, count(DISTINCT dep_path) AS n, array_to_string(list_sort(list(DISTINCT dep_path)), ' ') AS deps FROM dep WHERE path IS NOT NULL AND dep_path IS NOT NULL GROUP BY ALL")
def fan_in(spark, d):
    """Each target with its dependencies in order, and their number. A target's list is its own row; targets are many, lists short."""
    t = by_file(spark, d, "expt_dependencies").where("path is not null and dep_path is not null").select("path", "dep_path").distinct()
    return t.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("dep_path")), " ").alias("deps"))


def _domains(spark, d, names: list[str]) -> dict[str, list[str]]:
    """Distinct values per parameter, in any spelling and notation: domains of a specification, at most 10,000 in all."""
    from ..session import bounded_rows

    rows = bounded_rows(cells(spark, d).where(F.col("parameter").isin(names)).select("parameter", "cell").distinct())
    if rows is None:
        raise ValueError("the domains have more than 10,000 values")
    return {n: [r.cell for r in rows if r.parameter == n] for n in names}


@R.query(f"WITH {CELLS}, dom AS (SELECT DISTINCT parameter, cell FROM cells) SELECT a.cell AS m, b.cell AS nsample FROM dom a, dom b WHERE a.parameter = 'm' AND b.parameter = 'nsample'")
def param_grid(spark, d):
    return G.expand(spark, _domains(spark, d, ["m", "nsample"]))


@R.query(f"WITH {CELLS}, dom AS (SELECT DISTINCT parameter, cell FROM cells) SELECT a.cell AS m, b.cell AS nsample FROM dom a, dom b WHERE a.parameter = 'm' AND b.parameter = 'nsample' AND NOT (a.cell IN ('1', '2') AND b.cell = '5')")
def param_grid_exclusions(spark, d):
    return G.expand(spark, _domains(spark, d, ["m", "nsample"]), [{"m": ["1", "2"], "nsample": "5"}, {"absent": "1"}])


@R.query(f"WITH {CELLS}, a AS (SELECT DISTINCT t.path, c.cell AS ntip FROM fil t JOIN cells c USING (path) WHERE t.step = 'tree' AND c.parameter = 'ntip'), g AS (SELECT DISTINCT cell AS ntip FROM cells JOIN dat USING (path) WHERE step = 'kernel' AND cells.parameter = 'ntip') SELECT path, ntip FROM a JOIN g USING (ntip)")
def prereq_natural_join(spark, d):
    """Target grid of kernels joined to the tree files that agree on the shared parameter."""
    ntip = cells(spark, d).where("parameter = 'ntip'").select("path", F.col("cell").alias("ntip"))
    trees = by_file(spark, d, "trace_files").where("step = 'tree'").select("path").join(ntip, "path").distinct()
    kernels = ntip.join(by_file(spark, d, "expt_data").where("step = 'kernel'").select("path"), "path", "left_semi").select("ntip").distinct()
    return G.prerequisites(kernels, trees).select("path", "ntip")


@R.query("SELECT file_id, ((row_number() OVER (ORDER BY file_id) - 1) % 8)::INTEGER AS process FROM trace_files")
def round_robin_assignment(spark, d):
    return C.round_robin(table(spark, d, "trace_files").select("file_id"), ["file_id"], 8)


@R.query(f"WITH {CELLS} SELECT experiment, step, sum(split_part(cell, ':', 1)::INT * 3600 + split_part(cell, ':', 2)::INT * 60 + split_part(cell, ':', 3)::INT)::BIGINT AS seconds FROM cells JOIN fil USING (path) WHERE parameter = 'walltime' AND regexp_matches(cell, '^[0-9]+:[0-9]+:[0-9]+$') GROUP BY ALL")
def walltime_totals(spark, d):
    t = cells(spark, d).where(F.col("parameter") == "walltime").where(F.col("cell").rlike("^[0-9]+:[0-9]+:[0-9]+$")).select("path", F.split("cell", ":").cast("array<bigint>").alias("h"))
    j = t.join(by_file(spark, d, "trace_files").select("path", "step", "experiment"), "path")
    return j.groupBy("experiment", "step").agg(F.sum(F.col("h")[0] * 3600 + F.col("h")[1] * 60 + F.col("h")[2]).alias("seconds"))


QUERIES, ORACLE = R.queries, R.oracle
