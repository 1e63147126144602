"""Schemas that drift between files: one consistent table and a report of every change.

Method: tagged-union inference. Each file is a map parameter -> (spellings, type tags, raw value); the schemas of all
files are fused into one that keeps, per parameter, every alternative type; a parameter with alternatives is split into
typed branch columns beside its canonical column. Changes are the differences between a file's tagged map and the one
before it in its series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import canonical_names, name_key, strip
from ..functions.values import parsed
from ..functions.stage import staged
from ..session import broadcast_if_small, materialise
from ..sources.headers import body, pairs, type_tag, typed_value, unquote
from .ordered import CHUNK_ROWS, previous

#: The type tags of YAML values, and the one of each kind of parameter.
TAGS = ("boolean", "float", "integer", "list", "string")
OWN_TAG = {"integer": "integer", "double": "float", "boolean": "boolean", "text": "string"}


def tagged_headers(files: DataFrame, header: str, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """files plus fields: the tagged map of the header, sorted by parameter; null where the header is no complete map.

    A key written twice keeps its last value, as in YAML; a parameter written under two spellings keeps the value of each
    in raws, the last one in raw. Unknown parameters are left out.
    """
    table = canonical_names(types, aliases)
    if table is None:
        raise ValueError("parameter_types and parameter_aliases must be small dimension tables")
    named = F.transform(F.col("_pairs"), lambda p: F.struct(table[name_key(p["key"])].alias("parameter"), strip(p["key"]).alias("spelling"), p["raw"].alias("raw")))
    rows = staged(staged(files, _body=body(F.col(header))), _pairs=pairs(F.col("_body"))).drop("_body")
    rows = staged(rows, _named=F.filter(named, lambda p: p["parameter"].isNotNull()))
    names = F.array_sort(F.array_distinct(F.transform(F.col("_named"), lambda p: p["parameter"])))

    def fused(name: Column) -> Column:
        own = F.filter(F.col("_named"), lambda p: p["parameter"] == name)
        tags = F.array_sort(F.array_distinct(F.array_compact(F.transform(own, lambda p: type_tag(p["raw"])))))
        spellings = F.array_sort(F.array_distinct(F.transform(own, lambda p: p["spelling"])))
        last = F.element_at(own, -1)["raw"]
        each = F.array_distinct(F.transform(spellings, lambda s: F.element_at(F.filter(own, lambda p: p["spelling"] == s), -1)["raw"]))
        return F.struct(name.alias("parameter"), spellings.alias("spellings"), tags.alias("tags"), last.alias("raw"), F.concat(F.array(last), F.array_remove(each, last)).alias("raws"))

    return staged(rows, fields=F.when(F.col("_pairs").isNotNull(), F.transform(names, fused))).drop("_pairs", "_named")


def tagged_rows(files: DataFrame, eav: DataFrame, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """files plus fields: the tagged map (without tags) of the attribute rows of each path; null where there are none."""
    table = canonical_names(types, aliases)
    if table is None:
        raise ValueError("parameter_types and parameter_aliases must be small dimension tables")
    spelled = eav.where("path is not null and parameter is not null").select("path", table[name_key(F.col("parameter"))].alias("parameter"), strip(F.col("parameter")).alias("spelling"))
    per_name = spelled.where("parameter is not null").groupBy("path", "parameter").agg(F.array_sort(F.collect_set("spelling")).alias("spellings"))
    field = F.struct("parameter", "spellings", F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("raw"))
    per_file = per_name.groupBy("path").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    return files.join(per_file, "path", "left")


def tagged_values(eav: DataFrame, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """(path, reading, fields): the tagged maps of the attribute rows of each path, with values and their type tags.

    Reading 1 has one value of each parameter; if the rows of a path disagree, further values are in further readings.
    """
    table = canonical_names(types, aliases)
    if table is None:
        raise ValueError("parameter_types and parameter_aliases must be small dimension tables")
    rows = eav.where(F.col("path").isNotNull() & (strip(F.col("path")) != "") & F.col("parameter").isNotNull())
    rows = rows.select("path", table[name_key(F.col("parameter"))].alias("parameter"), strip(F.col("parameter")).alias("spelling"), strip(F.col("value")).alias("raw")).where("parameter is not null")
    values = rows.groupBy("path", "parameter", "raw").agg(F.array_sort(F.collect_set("spelling")).alias("spellings"))
    w = Window.partitionBy("path", "parameter").orderBy(F.col("raw").asc_nulls_last())  # the values of one parameter of one file
    values = values.withColumn("reading", F.row_number().over(w)).where("raw is not null or reading = 1")
    field = F.struct("parameter", "spellings", F.array_compact(F.array(type_tag(F.col("raw")))).alias("tags"), "raw")
    return values.groupBy("path", "reading").agg(F.array_sort(F.collect_list(field)).alias("fields"))


def header_readings(files: DataFrame) -> DataFrame:
    """tagged_headers with a row per reading: reading 1 has one value of each parameter, further ones those of its other spellings."""
    most = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("fields", lambda f: F.size(f["raws"]))), F.lit(1)))
    rows = files.withColumn("reading", F.explode(F.sequence(F.lit(1), most)))

    def one(f: Column) -> Column:
        raw = F.get(f["raws"], F.col("reading") - 1)
        return F.struct(f["parameter"].alias("parameter"), f["spellings"].alias("spellings"), F.array_compact(F.array(type_tag(raw))).alias("tags"), raw.alias("raw"))

    return staged(rows, fields=F.transform(F.filter("fields", lambda f: F.size(f["raws"]) >= F.col("reading")), one))


def fused_series(files: DataFrame, series: list[str]) -> DataFrame:
    """(series, parameter, n_files, alternatives): the schemas of all files of a series in one, every parameter with whether its
    spellings or type tags have alternatives and in how many files it is. Aggregated on the map side."""
    each = files.select(*series, F.explode("fields").alias("f"))
    apart = lambda k: F.min(f"f.{k}") != F.max(f"f.{k}")
    return each.groupBy(*series, F.col("f.parameter").alias("parameter")).agg(F.count("*").alias("n_files"), (apart("spellings") | apart("tags")).alias("alternatives"))


def changes(files: DataFrame, series: list[str], order: list[str], id_col: str, target: int = CHUNK_ROWS) -> DataFrame:
    """(id, parameter, change) between each file and the last one before it that has fields.

    The files of a series are fused first; parameters that all of them have without alternatives can't change and leave
    before the files are put in order. change: added, removed, renamed (no spelling in common), retyped (no type tag in
    common; null has no type). The first
    file of a series has no changes; files without fields are passed over; ties of the first order column are broken by
    the following ones. A series may hold any share of the files (cut into chunks above target files).
    """
    slim = F.transform("fields", lambda f: F.struct(f["parameter"].alias("parameter"), f["spellings"].alias("spellings"), f["tags"].alias("tags")))
    rows = materialise(files.where("fields is not null").select(*dict.fromkeys([*series, *order, id_col]), slim.alias("fields")), "fields")  # parsed once
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in series]
    total = rows.groupBy(*series).agg(F.count("*").alias("_n"))
    fused = fused_series(rows, series).alias("f").join(total.alias("t"), same("f", "t")).where("alternatives or n_files < _n")
    varying = broadcast_if_small(fused.groupBy(*[F.col(f"f.{k}").alias(k) for k in series]).agg(F.collect_set("parameter").alias("_varying")))
    rows = rows.alias("r").join(varying.alias("v"), same("r", "v")).select("r.*", "_varying")
    rows = rows.withColumn("fields", F.filter("fields", lambda f: F.array_contains(F.col("_varying"), f["parameter"]))).drop("_varying")
    rows = previous(rows, series, order, ["fields"], "_before", target).where("_before is not null and fields <> _before.fields")
    rows = rows.select(id_col, "fields", "_before")
    now, old = F.col("fields"), F.col("_before.fields")

    def find(where: Column, name: Column) -> Column:
        return F.get(F.filter(where, lambda f: f["parameter"] == name), F.lit(0))

    names = F.array_distinct(F.concat(F.transform(now, lambda f: f["parameter"]), F.transform(old, lambda f: f["parameter"])))
    each = rows.select(id_col, F.explode(F.transform(names, lambda n: F.struct(n.alias("parameter"), find(now, n).alias("now"), find(old, n).alias("old")))).alias("f"))
    n, o = F.col("f.now"), F.col("f.old")
    both = n.isNotNull() & o.isNotNull()
    apart = lambda k: both & (F.size(n[k]) > 0) & (F.size(o[k]) > 0) & ~F.arrays_overlap(n[k], o[k])
    found = F.array_compact(F.array(F.when(o.isNull(), "added"), F.when(n.isNull(), "removed"), F.when(apart("spellings"), "renamed"), F.when(apart("tags"), "retyped")))
    return each.select(id_col, "f.parameter", F.explode(found).alias("change"))


def alternatives(files: DataFrame, file: str | None = None, at: str | None = None) -> DataFrame:
    """(parameter, tag, n_files): the fused schema with every alternative type of each parameter; rows of one file count once.

    With at, the time of a row, also first_at and first_file: when and where the alternative appears, ties to the least file.
    """
    n = F.count_distinct(file) if file else F.count("*")
    first = F.min(F.when(F.col(at).isNotNull(), F.struct(F.col(at).alias("at"), F.col(file).alias("file")))) if at else None
    keep = [c for c in (file, at) if c]
    rows = files.select(*keep, F.explode("fields").alias("f")).select(*keep, "f.parameter", F.explode("f.tags").alias("tag"))
    if first is None:
        return rows.groupBy("parameter", "tag").agg(n.alias("n_files"))
    return rows.groupBy("parameter", "tag").agg(n.alias("n_files"), first.alias("_f")).select("parameter", "tag", "n_files", F.col("_f.at").alias("first_at"), F.col("_f.file").alias("first_file"))


def unified(files: DataFrame, kinds: dict[str, str], keep: list[str], written: Column | None = None) -> DataFrame:
    """One row per row of files: keep, one canonical typed column per parameter and a typed branch <parameter>__<tag> per alternative.

    A value that converts to the parameter's type fills the canonical column; one that does not fills the branch of its
    tag: BIGINT, DOUBLE, BOOLEAN, STRING or ARRAY<STRING>; the tag of the parameter's own type has a branch if there are
    such values. What neither can hold (an integer beyond 64 bits) stands as written in <parameter>__unread. Files without a
    complete header keep their row, with nulls. kinds: parameter -> value_type. written: where values are YAML (quoted,
    lists), all if None.
    """
    written = F.lit(True) if written is None else written
    if not kinds:
        return files.select(*keep)
    kind_of = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])

    def fields(step) -> Column:
        return F.transform("_f", lambda f: F.struct(*[e.alias(n) for n, e in step(f).items()]))

    def read(f: Column) -> dict[str, Column]:
        plain = F.when(written, unquote(f["raw"])).otherwise(f["raw"])
        return {"parameter": f["parameter"], "raw": f["raw"], "plain": plain, "tag": type_tag(f["raw"]), "kind": kind_of[f["parameter"]]}

    def stripped(f: Column) -> dict[str, Column]:
        return {**{n: f[n] for n in ("parameter", "raw", "plain", "tag", "kind")}, "v": F.when(~written | (f["tag"] != "list"), strip(f["plain"]))}

    def converted(f: Column) -> dict[str, Column]:
        return {**{n: f[n] for n in ("parameter", "raw", "plain", "tag", "kind")}, **{k: F.when(f["kind"] == k, parsed(f["v"], k)) for k in OWN_TAG}}

    def branched(f: Column) -> dict[str, Column]:
        lost = f["raw"].isNotNull() & F.coalesce(*[f[k].cast("string") for k in OWN_TAG]).isNull()
        branch = {t: F.when(lost & (f["tag"] == t), f["plain"] if t == "string" else typed_value(f["raw"], t)) for t in TAGS}
        return {"parameter": f["parameter"], "tag": f["tag"], "plain": f["plain"], "lost": lost, **{k: f[k] for k in OWN_TAG}, **{f"as_{t}": c for t, c in branch.items()}}

    def unread(f: Column) -> dict[str, Column]:
        none = F.coalesce(*[f[f"as_{t}"].cast("string") for t in TAGS]).isNull()
        return {**{n: f[n] for n in ("parameter", "tag", "lost", *OWN_TAG, *[f"as_{t}" for t in TAGS])}, "unread": F.when(f["lost"] & f["tag"].isNotNull() & none, f["plain"])}

    # each step handles all parameters of a row at once, so the plan doesn't grow with them
    files = staged(files, _f=F.filter("fields", lambda f: kind_of[f["parameter"]].isNotNull()))
    for step in (read, stripped, converted, branched, unread):
        files = staged(files, _f=fields(step))
    files = materialise(files.select(*keep, "_f"), "unified")
    each = files.select(F.explode("_f").alias("f")).groupBy("f.parameter", "f.tag").agg(F.bool_or("f.lost").alias("lost"), F.bool_or(F.col("f.unread").isNotNull()).alias("unread"))
    seen = sorted((r.parameter, r.tag, r.lost, r.unread) for r in each.where("tag is not null").collect())  # parameters times five tags at most
    branches = [(p, t) for p, t, lost, _ in seen if t != OWN_TAG[kinds[p]] or lost]
    lists = sorted({p for p, _, _, u in seen if u})

    def value(p: str, field: str) -> Column:
        return F.get(F.filter("_f", lambda f: f["parameter"] == p), F.lit(0))[field]

    canonical = [value(p, k).alias(p if p not in keep else f"{p}_value") for p, k in kinds.items()]
    return files.select(*keep, *canonical, *[value(p, f"as_{t}").alias(f"{p}__{t}") for p, t in branches], *[value(p, "unread").alias(f"{p}__unread") for p in lists])
