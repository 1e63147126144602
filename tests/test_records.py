"""Edge cases of the record operators: nulls, empty tables and texts, ties, repeats, clashing columns, very long values."""

import json

import pytest
from pyspark.sql import functions as F

from sweepframe.functions.names import file_key
from sweepframe.operators import bloom, eav, nested, orphans, schema_drift, timestamps
from sweepframe.sources import headers

TYPES = [("N", "integer"), ("alpha", "double"), ("nltt", "boolean"), ("model", "text"), ("ordinal", "integer")]
ALIASES = [("nodes", "N"), ("attach_power", "alpha"), (None, "N"), ("x", None)]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(TYPES, "parameter string, value_type string"), spark.createDataFrame(ALIASES, "alias string, parameter string")


def header_pairs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, h string")
    out = df.select("i", headers.pairs(headers.body(F.col("h"))).alias("p")).orderBy("i").collect()
    return [None if r.p is None else [(e.key, e.raw) for e in r.p] for r in out]


def test_header_forms(spark):
    got = header_pairs(spark, ["#{N: 5, 'a b': \"x, y\", l: [1, 2], e: }", "##{}", "% N: 1\n% m: ~\r\n", '  comment "{N: 3}"', "# {N: 1, m", "# {N: 1", "# N: '9", "", None, "plain", "#{a: 'it''s', b: true} \r", "# N: 1\n# m: ", "# m:"])
    assert got[0] == [("N", "5"), ("a b", '"x, y"'), ("l", "[1, 2]"), ("e", "")]
    assert got[1] == [] and got[2] == [("N", "1"), ("m", "~")] and got[3] == [("N", "3")]
    assert got[4:10] == [None] * 6 and got[10] == [("a", "'it''s'"), ("b", "true")] and got[11:] == [[("N", "1"), ("m", "")], [("m", "")]]


def test_type_tags(spark):
    raw = ["1", "-0x1F", "1.0e-05", "1e-05", "9.", "true", "No", "'1'", '"x"', "[1]", "~", "", "SI", ".inf", "08:15:00", "010"]
    df = spark.createDataFrame([(r,) for r in raw], "r string")
    assert [r.t for r in df.select(headers.type_tag(F.col("r")).alias("t")).collect()] == ["integer", "integer", "float", "string", "float", "boolean", "boolean", "string", "string", "list", None, None, "string", "float", "string", "integer"]


def test_changes(spark, names):
    rows = [(1, "e", "s", 1, "#{N: 1, alpha: 0.5}"), (2, "e", "s", 2, None), (3, "e", "s", 3, "#{nodes: 1.0, nltt: true}"), (4, "e", "s", 3, "#{nodes: 'x', nltt: null}"), (5, "f", "s", 1, "#{N: 1}"), (6, None, "s", 1, "#{N: 1}"), (7, None, "s", 2, "#{}")]
    df = spark.createDataFrame(rows, "file_id long, experiment string, step string, written_at long, yaml string").withColumn("raw", F.lit(1))
    tagged = schema_drift.tagged_headers(df.drop("raw"), "yaml", *names)
    expected = {(3, "N", "renamed"), (3, "N", "retyped"), (3, "alpha", "removed"), (3, "nltt", "added"), (4, "N", "retyped"), (7, "N", "removed")}
    for target in (1000, 2):
        got = schema_drift.changes(tagged, ["experiment", "step"], ["written_at", "file_id"], "file_id", target).collect()
        assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    alt = {(r.parameter, r.tag, r.n_files) for r in schema_drift.alternatives(tagged).collect()}
    assert alt == {("N", "integer", 3), ("N", "float", 1), ("N", "string", 1), ("alpha", "float", 1), ("nltt", "boolean", 1)}
    wide = {r.file_id: r for r in schema_drift.unified(tagged, dict(TYPES), ["file_id"]).collect()}
    assert (wide[1].N, wide[1].alpha, wide[3].N, wide[4].N, wide[4]["N__string"], wide[2].N) == (1, 0.5, 1, None, "x", None)
    assert schema_drift.changes(tagged.limit(0), ["experiment", "step"], ["written_at", "file_id"], "file_id").count() == 0


def test_rows_as_schema(spark, names):
    files = spark.createDataFrame([(1, "e", "s", 1, "p"), (2, "e", "s", 2, "q"), (3, "e", "s", 3, "r")], "file_id long, experiment string, step string, written_at long, path string")
    data = spark.createDataFrame([("s", "p", "N\t", "1"), ("s", "p", "N", "2"), ("s", "r", " nodes", "1"), ("s", None, "N", "1"), ("s", "r", None, "1"), ("s", "r", "unknown", "1")], "step string, path string, parameter string, value string")
    got = schema_drift.changes(schema_drift.tagged_rows(files, data, *names), ["experiment", "step"], ["written_at", "file_id"], "file_id").collect()
    assert {tuple(r) for r in got} == {(3, "N", "renamed")}


def test_wide(spark, names):
    long_text = "x" * 300_000
    rows = [("p", "nodes", "1,000"), ("p", "N", "1e3"), ("p", "N", "7"), ("p", "N", "1.5"), ("p", "alpha", ".125"), ("p", "alpha", "1e-05"), ("p", "nltt", " Yes"), ("q", "model", long_text), ("q", "model", "NaN"), (None, "N", "1"), (" ", "N", "1"), ("r", "N", None), ("q", None, "1"), ("q", "ordinal", "+05"), ("p", "N", "99999999999999999999999")]
    data = spark.createDataFrame(rows, "path string, parameter string, value string").withColumn("entity", F.lit("clash"))
    wide, others = eav.widen(eav.distinct_cells(eav.typed_cells(data, *names)), dict(TYPES))
    w = {r.entity: r for r in wide.collect()}
    assert set(w) == {"p", "q"} and len({r.ordinal for r in w.values()}) == 2
    assert (w["p"].N, w["p"].alpha, w["p"].nltt, w["q"].model, w["q"].ordinal_value) == (7, 1e-05, True, long_text, 5) and sorted(w["p"].more) == ["N", "alpha"] and w["q"].more == []
    assert {tuple(r) for r in others.collect()} == {("p", "N", "1000"), ("p", "alpha", "0.125000")}
    cells = {tuple(r) for r in eav.narrow(wide, others, dict(TYPES)).collect()}
    assert cells == {("p", "N", "1000"), ("p", "N", "7"), ("p", "alpha", "0.125000"), ("p", "alpha", "0.000010"), ("p", "nltt", "true"), ("q", "model", long_text), ("q", "ordinal", "5")}
    none, rest = eav.widen(eav.distinct_cells(eav.typed_cells(data.limit(0), *names)), dict(TYPES))
    assert none.count() == 0 and rest.count() == 0


def test_wide_over_many_batches(spark, names):
    """Entities that go on in the next Arrow batch, several ranges in one task, many attributes."""
    kinds = {f"a{k}": ("integer", "double", "boolean", "text")[k % 4] for k in range(12)}
    types, none = spark.createDataFrame(list(kinds.items()), "parameter string, value_type string"), names[1].limit(0)
    value = {"integer": str, "double": lambda i: f"{i}.5", "boolean": lambda i: "yes" if i % 3 else "no", "text": lambda i: f"t{i}"}
    rows = [(f"e{i:04d}", p, value[k](i)) for i in range(700) for n, (p, k) in enumerate(kinds.items()) if (i + n) % 5]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        cells = eav.distinct_cells(eav.typed_cells(spark.createDataFrame(rows, "path string, parameter string, value string").repartition(3), types, none))
        wide, others = eav.widen(cells, kinds)
        got = {r.entity: r for r in wide.coalesce(2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 700 == len({r.ordinal for r in got.values()}) and others.count() == 0
    for b in range(4):
        own = sorted(r.ordinal - (b << 33) for r in got.values() if r.ordinal >> 33 == b)
        assert own == list(range(len(own)))
    read = {"integer": int, "double": float, "boolean": lambda s: s == "yes", "text": str}
    for i in range(700):
        want = {p: read[kinds[p]](value[kinds[p]](i)) for n, p in enumerate(kinds) if (i + n) % 5}
        assert {p: got[f"e{i:04d}"][p] for p in kinds} == {p: want.get(p) for p in kinds}


def test_file_keys(spark):
    df = spark.createDataFrame([(" a//b\\c ",), ("./a/./b/",), ("a/x/../b",), ("/a/../../b",), ("",), (None,), ("A/b",)], "p string")
    assert [r.k for r in df.select(file_key(F.col("p")).alias("k")).collect()] == ["a/b/c", "a/b", "a/b", "/b", "", None, "A/b"]


def brute_orphans(refs, parents):
    out = set()
    for i, f, k, t in refs:
        own = [(s, p) for kk, s, p in parents if kk == k]
        by = [p for s, p in own if s is not None and s <= t]
        if not own:
            out.add((i, f, "missing"))
        elif not by:
            out.add((i, f, "late"))
        elif all(p is not None and p <= t for p in by):
            out.add((i, f, "deleted"))
    return out


@pytest.mark.parametrize("target", [100_000, 5])
def test_orphans(spark, target):
    import random

    r = random.Random(4)
    parents = [(r.choice("abcd"), r.choice([None, *range(20)]), r.choice([None, *range(25)])) for _ in range(40)] + [("solo", 5, None), (None, 1, 1)]
    refs = [(i, r.choice(["path", "dep"]), r.choice("aaabcdxyz") if i % 9 else "solo", r.randint(0, 30)) for i in range(200)]
    refs += refs[:5]
    p = spark.createDataFrame(parents, "key string, stored int, purged int").withColumn("at", F.lit(1))
    got = orphans.orphans(spark.createDataFrame(refs, "id int, ref_field string, key string, at int"), p, F.col("key"), "stored", "purged", target).select("id", "ref_field", "kind").collect()
    assert {tuple(x) for x in got} == brute_orphans(refs, [x for x in parents if x[0]]) and len(got) == len({tuple(x) for x in got})
    empty = orphans.orphans(spark.createDataFrame(refs[:3], "id int, ref_field string, key string, at int"), p.limit(0), F.col("key"), "stored", "purged").collect()
    assert {x.kind for x in empty} == {"missing"}


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k"))
    f = bloom.build(keys, F.col("k"), 5000)
    probe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).withColumn("hit", bloom.might_contain(F.col("k"), f))
    n = probe.where("hit").count()
    assert probe.where("hit and cast(substring(k, 2, 9) as int) < 5000").count() == 5000 and n < 5600
    assert spark.createDataFrame([(None,)], "k string").select(bloom.might_contain(F.col("k"), f).alias("h")).first().h is False


def test_nested(spark):
    q = lambda n, v=None: {"GBQualifier_name": n, "GBQualifier_value": v}
    full = {"GBSeq_feature-table": [{"GBFeature_key": "source", "GBFeature_quals": [q("a", "1"), None, q("b")], "GBFeature_intervals": {"GBInterval_point": 7}}, None, {"GBFeature_key": "gene", "GBFeature_quals": {"GBQualifier": q("g", "é")}, "GBFeature_intervals": {"GBInterval": [{"GBInterval_from": "1", "GBInterval_to": 9}]}}]}
    text = {"GBSeq_feature-table": json.dumps({"GBFeature_key": "lone"})}
    rows = [(1, json.dumps(full)), (2, json.dumps({"GBSet": {"GBSeq": text}})), (3, json.dumps([{"GBSeq_feature-table": {"GBFeature": {"GBFeature_key": "w"}}}])), (4, json.dumps(full)[:-3]), (5, None), (6, ""), (7, "null"), (8, "[]"), (9, '{"GBSeq_feature-table": null}'), (10, "[" * 5000), (1, json.dumps(text))]
    df = spark.createDataFrame(rows, "record_id long, record string").withColumn("node_type", F.lit("clash"))
    got = [tuple(r) for r in nested.flat_items(nested.node_table(df, "record", ["record_id"]), "record_id").collect()]
    assert sorted(got) == sorted([(1, 1, "feature", 0, "source"), (1, 1, "qual", 1, "a"), (1, 1, "qual", 3, "b"), (1, 1, "interval", 1, "7..7"), (1, 3, "feature", 0, "gene"), (1, 3, "qual", 1, "g"), (1, 3, "interval", 1, "1..9"), (2, 1, "feature", 0, "lone"), (3, 1, "feature", 0, "w"), (1, 1, "feature", 0, "lone")])
    nodes = nested.node_table(df, "record", ["record_id"])
    assert nested.qualifiers(nodes, "record_id").where("name = 'g'").first().value == "é"
    kids, up = nodes.where("node_type <> 'feature'").alias("c"), nodes.where("node_type = 'feature'").alias("p")
    assert kids.join(up, F.expr("c.parent_pre = p.pre and c.pre > p.pre and c.post < p.post")).count() >= 5
    assert nested.node_table(df.limit(0), "record", ["record_id"]).count() == 0
    one, many = (sorted(tuple(r) for r in nodes_of.collect()) for nodes_of in (nested.node_table(df.coalesce(1), "record", ["record_id"]), nested.node_table(df.repartition(7), "record", ["record_id"])))
    assert one == many and min(r[2] for r in one) == 1  # labels are those of the record
    deep = json.dumps({"GBSeq_feature-table": {"GBFeature_key": "deep"}})
    for _ in range(6):
        deep = json.dumps([[json.dumps({"GBSet": [{"GBSeq": json.loads(deep)}]})]])
    several = json.dumps([{"GBSeq_feature-table": {"GBFeature_key": "x"}}, None, {"GBSeq_feature-table": [{"GBFeature_key": "y"}]}])
    got = nested.flat_items(nested.node_table(spark.createDataFrame([(1, deep), (2, several)], "record_id long, record string"), "record", ["record_id"]), "record_id").collect()
    assert sorted((r.record_id, r.feature_no, r.item) for r in got) == [(1, 1, "deep"), (2, 1, "x"), (2, 2, "y")]


CASES = [
    ("2001", None, ("year", "2001")), (" 2001-08 ", None, ("month", "2001-08")), ("08/1985", None, ("month", "1985-08")), ("Sept-2001", None, ("month", "2001-09")), ("2001-13", None, None),
    ("1989/1/27", None, ("day", "1989-01-27")), ("30-02-2002", None, None), ("09/06/2005", None, None), ("06/06/2005", None, ("day", "2005-06-06")), ("09/14/1993", None, ("day", "1993-09-14")), ("13.3.2020", None, ("day", "2020-03-13")),
    ("1-Dec-68", None, ("day", "2068-12-01")), ("1-Dec-69", None, ("day", "1969-12-01")), ("29 Feb 2000", None, ("day", "2000-02-29")), ("Feb 29, 1900", None, None), ("20120718", None, ("day", "2012-07-18")),
    ("1657795299", None, ("time", "2022-07-14T10:41:39.000000Z")), ("1268527690978", None, ("time", "2010-03-14T00:48:10.978000Z")), ("2011-09-02T07:30:44.755161411Z", None, ("time", "2011-09-02T07:30:44.755161Z")),
    ("29-Oct-2017 00:46:22", None, None), ("29-Oct-2017 00:46:22", "Europe/Zurich", ("time", "2017-10-28T22:46:22.000000Z")), ("2017-10-29T02:30", "Europe/Zurich", None), ("2017-03-26 02:30", "Europe/Zurich", None),
    ("2017-10-29T02:30 CEST", "Asia/Tokyo", ("time", "2017-10-29T00:30:00.000000Z")), ("2022-01-22T01:22:29 +0545", None, ("time", "2022-01-21T19:37:29.000000Z")), ("October 25, 2020 at 12:18 am -03:30", None, ("time", "2020-10-25T03:48:00.000000Z")),
    ("20131020T060357 America/Denver", None, ("time", "2013-10-20T12:03:57.000000Z")), ("2019-08-28 03:58 [america/denver]", None, ("time", "2019-08-28T09:58:00.000000Z")), ("2019-08-28 03:58 Mars/Base", "UTC", None), ("2019-08-28 24:10Z", None, None),
    ("ca. 1988", None, None), ("1987/1989", None, None), ("unknown", "UTC", None), ("", "UTC", None), (None, "UTC", None), ("x" * 100_000, "UTC", None), ("2015-01-01T00:00", "Nowhere/Zone", None), ("1.3.2020", None, None), ("3.3.2020", None, ("day", "2020-03-03")), ("13.3.2020", None, ("day", "2020-03-13")), ("3.13.2020", None, ("day", "2020-03-13")),
]


def test_timestamps(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string").withColumn("precision", F.lit("clash"))
    got = {r.i: (r.precision, r.normal) for r in timestamps.normalise(df.drop("precision"), "v", "z", ["i"]).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: c[2] for i, c in enumerate(CASES)}


def test_session_zone_does_not_matter(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        test_timestamps(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_zone_estimate(spark):
    """Lags of months decide nothing by themselves: declared zones of the group do, short lags do, ties abstain."""
    tokyo = [("t1", "lag", f"2020-01-{d:02d}T12:00:00", f"2020-01-{d:02d} 03:30:00", None) for d in range(1, 20)]
    months = [("m1", "study", "2020-06-01 12:00", "2021-02-01 00:00:00", None), ("m2", "none", "2020-06-01 12:00", "2021-02-01 00:00:00", None), ("m3", None, "2020-06-01 12:00", "2021-02-01 00:00:00", None)]
    held = [("m4", "study", "2020-06-01 12:00", "2021-02-01 00:00:00", " america/new_york "), ("m5", "study", "unknown", "2021-02-01 00:00:00", "America/New_York"), ("m6", "study", "unknown", "2021-02-01 00:00:00", "UTC")]
    own = [("s", "study", "2020-06-01 12:00", "2021-02-01 00:00:00", None), ("s", "study", "unknown", "2021-03-01 00:00:00", "UTC"), ("h", "split", "2020-03-08 02:30", None, None), ("x", "split", None, None, "America/New_York"), ("m7", "study", "unknown", None, "America/New_York"), ("y", "split", None, None, "America/New_York")]
    rows = [(i, *r) for i, r in enumerate([*tokyo, *months, *held, *own])]
    df = spark.createDataFrame(rows, "i int, seq string, g string, v string, s string, z string").withColumn("seen", F.col("s").cast("timestamp_ntz")).withColumn("zone", F.lit("clash"))
    got = {r.i: r for r in timestamps.estimate_zones(df, df, ["i"], {"seq": "sequence", "g": "study"}, "v", "z", "seen", ["UTC", "Asia/Tokyo", "America/New_York"]).collect()}
    assert all(got[i].zone == "Asia/Tokyo" and got[i].share is None for i in range(19)) and got[0].normal == "2020-01-01T03:00:00.000000Z"
    assert (got[19].zone, got[19].basis, got[19].share, got[19].normal) == ("America/New_York", "study", 0.6, "2020-06-01T16:00:00.000000Z")
    assert [got[i].zone for i in (20, 21)] == [None, None] and got[20].normal is None
    assert (got[25].zone, got[25].basis, got[25].normal) == ("UTC", "sequence", "2020-06-01T12:00:00.000000Z")
    assert (got[27].zone, got[27].normal) == ("America/New_York", None)  # that zone skips the hour
    assert sorted(got) == [*range(19), 19, 20, 21, 25, 27]
    assert timestamps.estimate_zones(df.limit(0), df, ["i"], {"g": "study"}, "v", "z", "seen", ["UTC"]).collect() == []


def test_zone_estimate_by_sequence(spark, monkeypatch):
    """Known times delivered just before and just after leave one zone; what is delivered at once has no order. Cut groups give the same."""
    day = [("a", "2020-06-01T02:30:00Z", "2021-01-01", None), ("a", "2020-06-01 12:00", "2021-01-02", None), ("a", "2020-06-01 05:30", "2021-01-03", "UTC")]
    once = [("b", "2020-06-01T02:30:00Z", "2021-01-02", None), ("b", "2020-06-01 12:00", "2021-01-02", None), ("b", "2020-06-01 05:30", "2021-01-02", "Mars/Base")]
    rest = [("c", "1591000000", "2021-01-02", None), ("c", "2020-06-01 05:30 MDT", "2021-01-02", "Asia/Tokyo"), ("c", "2020-06", "2021-01-02", None), ("c", "1 June 2020", None, None), ("c", "ca. 1988", None, None)]
    twice = [("d", "2020-11-01 01:30", "2021-01-03", None), ("d", "2019-01-01T00:00Z", "2021-01-04", None), ("d", "unknown", "2021-01-04", "America/New_York")]  # a step that every zone puts in the wrong order, also the one that has the time twice
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([*day, *once, *rest, *twice])], "i int, g string, v string, s string, z string").withColumn("seen", F.col("s").cast("timestamp_ntz"))
    votes, zones = df.where("g <> 'a'"), ["America/New_York", "Asia/Tokyo", "UTC"]
    for size in (500_000, 1):
        monkeypatch.setattr(timestamps.previous, "__defaults__", (*timestamps.previous.__defaults__[:-1], size))
        got = {r.i: r for r in timestamps.estimate_zones(df, votes, ["i"], {"g": "study"}, "v", "z", "seen", zones).collect()}
        assert {i: r.zone for i, r in got.items()} == {1: "Asia/Tokyo", 4: None, 5: None, 11: None} and got[1].normal == "2020-06-01T03:00:00.000000Z"
    whole = {r.i: r for r in timestamps.resolve(df, votes, ["i"], {"g": "study"}, "v", "z", "seen", zones).collect()}
    stated = {r.i: (r.precision, r.normal) for r in timestamps.normalise(df, "v", "z", ["i"]).collect()}
    assert sorted(whole) == [*range(10), 11, 12] and {i: (r.precision, r.normal) for i, r in whole.items() if i not in got} == stated
    assert all((whole[i].precision, whole[i].zone, whole[i].normal) == ("time", got[i].zone, got[i].normal) for i in got)
    assert [(whole[i].zone, whole[i].basis) for i in (0, 1, 2, 6, 7, 8, 9)] == [(None, "written"), ("Asia/Tokyo", "study"), ("UTC", "declared"), (None, "written"), (None, "written"), (None, None), (None, None)]


def test_catalogue_and_headers_in_one_table(spark, names, tmp_path):
    from sweepframe.plans import record_queries

    files = [(1, "e", "s", "p", "# N: 0x1F\n# alpha: .inf\n"), (2, "e", "s", "q", "# N: 99999999999999999999999\n"), (3, "e", "s", "r", None)]
    spark.createDataFrame(files, "file_id long, experiment string, step string, path string, yaml string").withColumn("written_at", F.current_timestamp()).write.parquet(f"{tmp_path}/trace_files.parquet")
    data = [("s", "p", "N", "5"), ("s", "p", "nodes", "7"), ("s", "p", "N", None), ("s", "lone", "alpha", "much"), ("s", "lone", "model", "[x"), ("s", None, "N", "1"), ("s", "none", "N", None)]
    spark.createDataFrame(data, "step string, path string, parameter string, value string").write.parquet(f"{tmp_path}/expt_data.parquet")
    for name, t in zip(("parameter_types", "parameter_aliases"), names):
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    out = record_queries.p1_unified(spark, str(tmp_path)).collect()
    got = {(r.path, r.origin, r.reading): r for r in out}
    assert len(out) == len(got) == 7 and {k[0] for k in got} == {"p", "q", "r", "lone", "none"}
    assert {got["p", "data", k].N for k in (1, 2)} == {5, 7} and got["p", "data", 1].file_id == 1 and got["lone", "data", 1].file_id is None
    lone = got["lone", "data", 1]
    assert lone.alpha is None and lone.alpha__string == "much" and lone.model == "[x" and got["none", "data", 1].N is None
    h = got["p", "yaml", 1].asDict()
    assert h["N"] is None and h["N__integer"] == 31 and h["alpha__float"] == float("inf") and "99999999999999999999999" == got["q", "yaml", 1]["N__unread"]
    assert "alpha__unread" not in h
    alt = {(r.parameter, r.tag): r for r in record_queries.p1_alternatives(spark, str(tmp_path)).collect()}
    assert alt["alpha", "string"].n_files == 1 and alt["N", "integer"].n_files == 2
    assert alt["N", "integer"].first_file == "p" and alt["N", "integer"].first_at is not None and alt["alpha", "string"].first_at is None


def test_typed_branches_and_readings(spark, names):
    rows = [(1, "{N: 0b101, nodes: [a, 'b c', \"d\"], alpha: 1:30.5, nltt: 017, model: Off}"), (2, "{N: 'x', alpha: -0x10, nltt: 2, model: ~}"), (3, "{N: 3, nodes: 3, 'n odes': 1_000}"), (4, None), (5, "{}")]
    tagged = schema_drift.tagged_headers(spark.createDataFrame(rows, "file_id int, h string"), "h", *names)
    got = {(r.file_id, r.reading): r for r in schema_drift.unified(schema_drift.header_readings(tagged), dict(TYPES), ["file_id", "reading"]).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (3, 1), (3, 2), (4, 1), (5, 1)}
    a = got[1, 1]
    assert (a.N, a["N__list"], a["alpha__float"], a["nltt__integer"], a.model) == (None, ["a", "b c", "d"], 90.5, 15, "Off") and got[1, 2]["N__integer"] == 5 and got[1, 2].alpha is None
    assert got[2, 1]["N__string"] == "x" and got[2, 1]["alpha__integer"] == -16 and got[2, 1]["nltt__integer"] == 2 and got[2, 1].model is None
    assert {got[3, 1].N, got[3, 1]["N__integer"], got[3, 2].N, got[3, 2]["N__integer"]} == {3, 1000, None}
