import random
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import text
from sweepframe.operators import catalogue, graphs, grid, kernels, stats, trees, weighted
from sweepframe.streaming.intervals import stream_periods


def test_domains():
    assert grid.domain("range(3)") == ["0", "1", "2"] and grid.domain("range(4, 0, -2)") == ["2", "4"]
    assert grid.domain("[i/100 for i in range(3)]") == ["0.0", "0.01", "0.02"]
    assert grid.domain("__import__('os')") == ["__import__('os')"] and grid.domain(["b", "a", "b"]) == ["a", "b"]
    assert grid.intersect({"a": [1, 2], "b": [3]}, {"a": [2, 5], "b": [4], "c": [1]}) == {"a": ["2"]}
    assert grid.restrict({"a": [1, 2], "b": [3]}, {"a": [2]}) == {"a": ["2"], "b": ["3"]}
    assert grid.seconds("08:15:00") == 29_700 and grid.render("{x} {{y}}", {"x": 1}) == "1 {y}"


def test_grid(spark):
    g = grid.expand(spark, {"nsimnode": [500, 1000, 2000], "ntip": [100, 500, 1000]}, [{"nsimnode": 500, "ntip": 1000}, {"gone": 1}])
    assert g.count() == 8 and grid.expand(spark, {}).count() == 1 and grid.expand(spark, {"a": []}).count() == 0
    assert grid.prerequisites(g, grid.expand(spark, {"ntip": [100], "m": [1, 2]})).count() == 6
    with pytest.raises(ValueError):
        grid.prerequisites(g, grid.expand(spark, {"m": [1, 2]}))
    seeds = grid.seed(g, g.columns)
    assert seeds.where("seed between 0 and 2147483647").count() == 8


def test_catalogue(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y"), (None, "z")], "src string, dst string")
    got = {r.node: r.depth for r in catalogue.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    loop = edges.union(spark.createDataFrame([("e", "a")], "src string, dst string"))
    assert catalogue.closure(loop, spark.createDataFrame([("e",)], "node string")).count() == 5
    nodes = spark.createDataFrame([(x,) for x in "abcdexy"], "node string")
    solid = edges.where("src is not null")
    assert {r.node: r.level for r in catalogue.levels(nodes, solid).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "x": 0, "y": 1}
    with pytest.raises(ValueError, match="cycle"):
        catalogue.levels(nodes, loop.where("src is not null"))
    points = spark.createDataFrame([("p", "b", "1"), ("p", "a", "2"), ("q", "a", "2"), ("q", "b", "1"), ("r", "a", "2"), ("p", "a", "2")], "path string, parameter string, cell string")
    name = {r.path: r.name for r in catalogue.canonical_point(points).collect()}
    assert name["p"] == name["q"] != name["r"]
    grid = points.withColumn("step", F.lit("s")).unionByName(spark.createDataFrame([("x", "c", "1", "s"), ("y", "c", "1", None)], "path string, parameter string, cell string, step string"))
    assert {tuple(r) for r in catalogue.grid_mismatches(grid).collect()} == {("s", "r", 1, 0), ("s", "x", 2, 1)}


def test_lineage(spark):
    links = spark.createDataFrame([("t", "e/s/a", "1"), ("t", "e/u/b", "2"), ("t", "e/u/c", "3"), ("v", "e/w/gone", "4"), ("v", None, "4"), ("ok", "e/s/a", "1")], "path string, dep_path string, dep_checksum string")
    md5 = spark.createDataFrame([("e/s/a", "1", 1), ("e/u/b", "9", 1), ("e/u/b", "2", 2), ("e/u/c", None, 1), (None, "7", 1)], "path string, checksum string, at int")
    newest = md5.where("at = 2 or path <> 'e/u/b'").select("path", "checksum")
    got = {tuple(r) for r in catalogue.stale(newest, links, F.split("dep_path", "/")[1]).collect()}
    assert got == {("t", 3, 1, True), ("v", 1, 1, False)}
    assert {tuple(r) for r in catalogue.with_checksums(links, md5, "at").collect()} == {("t", "e/s/a", "1"), ("t", "e/u/b", "2"), ("t", "e/u/c", None), ("v", "e/w/gone", None), ("ok", "e/s/a", "1")}
    left = catalogue.delete_files(links, spark.createDataFrame([("t",), ("e/s/a",), (None,)], "path string"), ["path", "dep_path"])
    assert {tuple(r) for r in left.collect()} == {("v", "e/w/gone", "4"), ("v", None, "4")}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(1000, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {n.node: n.component for n in graphs.components(spark.createDataFrame(pairs, "src int, dst int")).collect()}
    assert got == {n: root(n) for n in parent}


def test_balance_and_distance(spark):
    rows = [("t", "r", None, 0.0), ("t", "x", "r", 1.0), ("t", "y", "r", 2.0), ("t", "a", "x", 1.0), ("t", "b", "x", 1.5), ("t", "z", "y", 1.0), ("t", "c", "y", 1.0), ("t", "d", "z", 1.0), ("t", "e", "z", 1.0), ("one", "q", None, None)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, length double")
    got = {r.tree: r for r in trees.balance(df).collect()}
    assert (got["t"].ntip, got["t"].sackin, got["t"].cherries, got["t"].colless, got["t"].width) == (5, 12, 2, 2, 4)
    assert got["t"].cophenetic == 1 + 3 + 1 and got["one"].ntip == 1 and got["one"].sackin == 0
    q = spark.createDataFrame([("t", "a", "e"), ("t", "d", "e"), ("t", "a", "a")], "tree string, a string, b string")
    assert {(r.a, r.b): r.distance for r in trees.patristic(df, q).collect()} == {("a", "e"): 6.0, ("d", "e"): 2.0, ("a", "a"): 0.0}


def test_step_distance(spark):
    curves = spark.createDataFrame([("a", 0.0, 0.5), ("a", 0.5, 1.0)], "k string, x double, f double")
    ref = spark.createDataFrame([(0.0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1.0)], "x double, f double")
    assert abs(trees.step_distance(curves, "k", ref).first().distance - 5 / 36) < 1e-12


def scan_hpd(x, w, conf):
    xs = np.unique(x)
    ws = np.array([w[x == v].sum() for v in xs])
    f = np.cumsum(ws) / ws.sum()
    f[0] = 0
    p = np.linspace(0, 1 - conf, 20001)
    return (np.interp(p + conf, f, xs) - np.interp(p, f, xs)).min()


@pytest.mark.parametrize("seed", range(3))
def test_hpd_is_never_wider_than_a_scan(spark, seed):
    r = np.random.default_rng(seed)
    x, w = r.normal(size=60).round(2), r.random(60)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, w)] + [("single", 3.0, 1.0), ("g", None, 1.0), ("g", 1.0, None)], "k string, x double, w double")
    for conf in (0.95, 0.5):
        got = {v.k: v for v in weighted.hpd(df, ["k"], "x", "w", conf).collect()}
        assert got["g"].upper - got["g"].lower <= scan_hpd(x, w, conf) + 1e-9
        assert got["single"].lower == got["single"].upper == 3.0


def test_p_values():
    assert abs(stats.student_p(2.228138851964939, 10) - 0.05) < 1e-9
    assert abs(stats.f_p(4.964602743730711, 1, 10) - 0.05) < 1e-9
    assert abs(stats.normal_p(1.959963984540054) - 0.05) < 1e-12


def test_kernels(spark):
    r = np.random.default_rng(0)
    rows = [(i, r.normal(size=4).round(3).tolist() if i != 5 else None, i % 3) for i in range(90)]
    rows = [(i, [v + 3 * (j == y) for j, v in enumerate(x)] if x else None, y) for i, x, y in rows]
    df = spark.createDataFrame(rows, "id long, v array<float>, y int")
    got = kernels.nearest_by_kernel(df, "id", "v", df.where("id % 10 = 0"), 0.1, 5).collect()
    v = {i: np.array(x, np.float32).astype(float) for i, x, _ in rows if x}
    for q in range(0, 90, 10):
        want = sorted(v, key=lambda i: (-round(float(np.exp(-0.1 * ((v[i] - v[q]) ** 2).sum())), 9), i))[:5]
        assert [g.id for g in sorted((g for g in got if g.query_id == q), key=lambda g: g.rank)] == want
    cv = kernels.ridge_cv(df, "id", "v", "y", F.floor(F.col("id") / 3) % 3, 3, 0.1).collect()
    assert sum(c.n for c in cv) == 89 and min(c.accuracy for c in cv) > 0.75
    assert kernels.principal_components(df, "id", "v", 0.1).count() == 89


def test_clip_and_dates(spark):
    df = spark.createDataFrame([("--AC-GT--A",)], "s string").withColumn("r", F.array(F.struct(F.lit(2).alias("from"), F.lit(3).alias("to"))))
    assert df.select(text.clip_ranges(F.col("s"), F.col("r")).alias("x")).first().x == "--AT--A"
    dates = spark.createDataFrame([("05-Mar-2010",), ("Mar-2010",), ("2010",), ("gone",), (None,)], "t string")
    assert [r.x for r in dates.select(text.dated_precision(F.col("t")).alias("x")).collect()] == ["days_14673", "months_482", "years_40", "NA_0", "NA_0"]


def test_resample_and_tolerance(spark):
    df = spark.createDataFrame([("g", i, float(1 + i % 4)) for i in range(40)], "k string, i int, w double")
    copies = weighted.systematic_resample(df, ["k"], "i", "w", 100).collect()
    assert sum(c.copies for c in copies) == 100 and all(abs(c.copies - (1 + c.i % 4)) <= 1 for c in copies)
    t = weighted.next_tolerance(df.withColumn("d", F.col("i").cast("double")), ["k"], "d", "w", 0.5).first()
    w = [1 + i % 4 for i in range(40)]
    ess = [sum(w[: n + 1]) ** 2 / sum(x * x for x in w[: n + 1]) for n in range(40)]
    assert t.epsilon == next(i for i, e in enumerate(ess) if e >= 0.5 * ess[-1])


def test_interval_stream(spark, tmp_path):
    src = tmp_path / "in"
    batches = [[("a", 1, 3), ("b", 9, 7)], [("a", 5, 8), ("a", None, 4)], [("a", 4, 4), ("a", 20, 21)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "g string, s int, e int").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("g string, s int, e int").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream_periods(stream, "g", "s", "e").writeStream.format("memory").queryName("periods").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("periods").collect()}
    assert {("a", "period", 1, 8), ("a", "gap", 9, 19), ("b", "period", 7, 9)} <= got


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(5)
    x = r.integers(0, 20, 101).astype(float)
    got = weighted.quantiles(spark.createDataFrame([("g", float(v)) for v in x], "k string, v double"), ["k"], "v", [0.025, 0.3, 0.5]).first()
    assert np.allclose([got.q0, got.q1, got.q2], np.quantile(x, [0.025, 0.3, 0.5])) and got.n == 101
    assert all(a <= b for a, b in pairwise([got.q0, got.q1, got.q2]))


def test_ladder_prune_and_scale(spark):
    rows = [("t", "r", None, 0.0), ("t", "x", "r", 1.0), ("t", "y", "r", 2.0), ("t", "a", "x", 1.0), ("t", "b", "x", 3.0), ("t", "c", "y", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, length double")
    pos = {r.node: r.child_pos for r in trees.ladderize(df).collect()}
    assert (pos["y"], pos["x"], pos["a"], pos["b"]) == (1, 2, 1, 2)
    drop = spark.createDataFrame([("t", "a")], "tree string, node string")
    assert {(r.node, r.parent, r.length) for r in trees.prune(df, drop).collect()} == {("r", None, 0.0), ("b", "r", 4.0), ("c", "r", 3.0)}
    both = spark.createDataFrame([("t", "a"), ("t", "b")], "tree string, node string")
    assert {(r.node, r.parent) for r in trees.prune(df, both).collect()} == {("c", None)}
    assert {r.node: r.length for r in trees.scale_branches(df).collect()}["b"] == 3.0 / 1.6


def test_sampling(spark):
    from sweepframe.operators import sampling

    df = spark.range(101).withColumns({"k": F.col("id") % 2, "w": F.when(F.col("id") < 50, 100.0).otherwise(1.0)})
    assert sampling.half_split(df, "id").where("half = 0").count() == 50
    s = sampling.weighted_sample(df, ["k"], "id", "w", 10)
    assert s.count() == 20 and s.where("id < 50").count() >= 16
    assert sampling.weighted_sample(df.withColumn("w", F.lit(0.0)), ["k"], "id", "w", 10).count() == 0


def test_checksums_and_varying_columns(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("c", bytearray(b"3"))], "path string, content binary")
    md5 = spark.createDataFrame([("a", "c4ca4238a0b923820dcc509a6f75849b"), ("b", "x")], "path string, checksum string")
    assert {tuple(r) for r in catalogue.verify_checksums(files, md5).collect()} == {("b", "changed"), ("c", "unregistered")}
    assert catalogue.varying_columns(spark.createDataFrame([(1, None, "x"), (1, "y", "x")], "a int, b string, c string")) == ["b"]


def test_anova_and_glm(spark):
    r = np.random.default_rng(3)
    rows = [("ab"[i % 2], "xyz"[i % 3], float(i % 2 * 2 + i % 3 + r.normal())) for i in range(120)]
    df = spark.createDataFrame(rows, "f string, g string, v double")
    out = {n: (k, ss) for n, k, ss in stats.sequential_anova(df, "v", ["f", "g"])}
    one = stats.anova(df, "f", "v").first()
    assert out["f"][0] == 1 and abs(out["f"][1] - one.ss_between) < 1e-6 and out["g"][0] == 2 and out["residuals"][0] == 116
    g = stats.glm(df.withColumn("y", F.exp("v")).withColumn("q", (F.col("f") == "b").cast("double")), "y", [("q",)], "gamma", "log")
    assert g[0][0] == "(intercept)" and g[1][1] > 0.5


def test_components_are_those_of_all_rows(spark):
    r = np.random.default_rng(3)
    v = {i: r.normal(size=3) for i in range(300)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()] + [(999, None)], "id long, v array<double>")
    got = {g.id: (g.pc1, g.pc2) for g in kernels.principal_components(df, "id", "v", 0.05, 100).collect()}
    x = np.array([v[i] for i in range(300)])
    k = kernels._rbf(x, x, 0.05)
    k = k - k.mean(0) - k.mean(1)[:, None] + k.mean()
    values, vectors = np.linalg.eigh(k)
    pc = np.array([got[i] for i in range(300)])
    assert len(got) == 300 and np.abs(pc.mean(0)).max() < 1e-6
    for j in (0, 1):
        want = vectors[:, -1 - j] * np.sqrt(values[-1 - j])
        assert min(np.abs(pc[:, j] - want).max(), np.abs(pc[:, j] + want).max()) < 0.02
    many = df.withColumn("y", F.col("id")).where("v is not null").withColumn("y", F.explode(F.sequence(F.col("y") * 4, F.col("y") * 4 + 3)))
    with pytest.raises(ValueError):
        kernels.ridge_cv(many, "id", "v", "y", F.lit(0), 3, 0.1)
    assert kernels.principal_components(df.limit(0), "id", "v", 0.1).count() == 0


def test_unfinished_rounds_raise(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(3)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "node long")
    assert catalogue.closure(edges, seeds, 4).count() == 4
    with pytest.raises(ValueError):
        catalogue.closure(edges, seeds, 3)
    with pytest.raises(ValueError):
        graphs.components(edges, 1)


def random_tree(r, n, ladder):
    """parents of node i among the nodes before it; a ladder hangs every node on the last but one."""
    return {i: (None if i == 0 else (i - 1 if ladder and i % 3 else r.randrange(i)), float(r.randint(0, 6))) for i in range(n)}


@pytest.mark.parametrize("ladder", [False, True])
def test_trees_equal_brute_force(spark, ladder):
    r = random.Random(ladder)
    forests = {f"t{k}": random_tree(r, n, ladder) for k, n in enumerate([1, 2, 40, 90])}
    nodes = spark.createDataFrame([(t, str(i), None if p is None else str(p), None if length == 6 else length) for t, f in forests.items() for i, (p, length) in f.items()], "tree string, node string, parent string, length double")
    size = {t: {i: (p, 0.0 if length == 6 or p is None else length) for i, (p, length) in f.items()} for t, f in forests.items()}

    def way(t, i):
        out, d = [], 0.0
        while i is not None:
            out.append((i, d))
            p, length = size[t][i]
            d, i = d + length, p
        return out

    tips = {t: [i for i in f if not any(p == i for p, _ in f.values())] for t, f in forests.items()}
    got = {(x.tree, int(x.node)): x for x in trees.labelled(nodes).collect()}
    assert len(got) == sum(map(len, forests.values()))
    for t, f in forests.items():
        below = {i: [dict(way(t, j))[i] for j in tips[t] if i in dict(way(t, j))] for i in f}
        for i in f:
            x = got[t, i]
            assert (x.depth, x.height, x.tips, x.near) == (len(way(t, i)) - 1, way(t, i)[-1][1], len(below[i]), min(below[i]))

    def distance(t, a, b):
        wa, wb = dict(way(t, a)), dict(way(t, b))
        return min(wa[k] + wb[k] for k in wa if k in wb)

    pairs = [(t, str(a), str(b)) for t, f in forests.items() for a in f for b in f if (a * 7 + b) % 11 == 0]
    far = trees.patristic(nodes, spark.createDataFrame([*pairs, ("t2", "0", "none")], "tree string, a string, b string")).collect()
    assert len(far) == len(pairs) and all(x.distance == distance(x.tree, int(x.a), int(x.b)) for x in far)
    for cutoff in (0.0, 3.0, 7.0):
        root = {(t, i): (t, i) for t in tips for i in tips[t]}
        for t in tips:
            for a in tips[t]:
                for b in tips[t]:
                    if distance(t, a, b) <= cutoff:
                        x, y = root[t, a], root[t, b]
                        root = {k: x if v == y else v for k, v in root.items()}
        label = {(x.tree, int(x.tip)): (x.tree, x.cluster) for x in trees.distance_clusters(nodes, cutoff).collect()}
        assert set(label) == set(root) and len({(label[k], root[k]) for k in root}) == len(set(label.values())) == len(set(root.values()))
    gone = {(t, i) for t in tips for i in tips[t] if i % 3}
    kept = {(x.tree, int(x.node)): x for x in trees.prune(nodes, spark.createDataFrame([(t, str(i)) for t, i in gone], "tree string, node string")).collect()}
    for t in tips:
        stay = [i for i in tips[t] if (t, i) not in gone]
        assert {i for (tt, i) in kept if tt == t} >= set(stay)
        kids = {}
        for (tt, i), x in kept.items():
            if tt == t and x.parent is not None:
                kids.setdefault(int(x.parent), []).append(i)
                assert x.length == dict(way(t, i))[int(x.parent)]
        assert all(len(v) > 1 for v in kids.values()) and {i for (tt, i) in kept if tt == t} == set(stay) | set(kids)


def test_shape_of_a_tree(spark):
    """A caterpillar of five tips with unit steps: three il nodes in a row above a cherry; gamma by hand."""
    rows = [("t", "r", None, 0.0), ("t", "a", "r", 1.0), ("t", "1", "r", 4.0), ("t", "b", "a", 1.0), ("t", "2", "a", 3.0), ("t", "c", "b", 1.0), ("t", "3", "b", 2.0), ("t", "4", "c", 1.0), ("t", "5", "c", 1.0), ("s", "x", None, 1.0)]
    got = {x.tree: x for x in trees.shape(spark.createDataFrame(rows, "tree string, node string, parent string, length double")).collect()}
    t, s = got["t"], got["s"]
    assert (t.il_nodes, t.max_ladder, t.max_delta_width, t.prop_unbalanced, round(t.mean_balance, 6), t.width_depth) == (3, 3, 1, 0.75, round((1 / 4 + 1 / 3 + 1 / 2 + 1) / 4, 6), 0.5)
    total = 2 + 3 + 4 + 5
    assert abs(t.gamma - ((2 + 5 + 9) / 3 - total / 2) / (total * (1 / 36) ** 0.5)) < 1e-12 and abs(t.int_tip_ratio - 1.0 / 2.2) < 1e-12
    assert (s.il_nodes, s.max_ladder, s.gamma, s.width_depth) == (0, 0, None, None)


def test_many_step_curves(spark):
    r = random.Random(4)
    steps = lambda n: sorted((r.randint(0, 8) / 8, r.randint(0, 6) / 6) for _ in range(n))
    curves = {f"k{i}": [(x, max(f for y, f in c if y <= x)) for x, _ in c] for i in range(25) for c in [steps(r.randint(1, 6))]}
    ref = [(x, max(f for y, f in c if y <= x)) for c in [steps(7)] for x, _ in c]
    at = lambda c, x: max([f for y, f in c if y <= x], default=0.0)
    want = {k: sum(abs(at(c, i / 8) - at(ref, i / 8)) / 8 for i in range(8)) for k, c in curves.items()}
    df = spark.createDataFrame([(k, x, f) for k, c in curves.items() for x, f in c] + [(None, 0.5, 1.0), ("k0", None, 1.0)], "k string, x double, f double")
    got = {x.k: x.distance for x in trees.step_distance(df, "k", spark.createDataFrame(ref, "x double, f double")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_power_law_tail(spark):
    """Degrees drawn from a discrete power law of exponent 2.5 above a disturbed head: the exponent comes back."""
    r = np.random.default_rng(2)
    k = np.arange(1, 100_001)
    w = k**-2.5 / (k**-2.5).sum()
    degrees = r.choice(k, 20_000, p=w)
    assert abs(stats._zeta(2.0, 1.0) - np.pi**2 / 6) < 1e-10 and abs(stats._zeta(2.5, 3.0) - (np.arange(3, 3_000_000.0) ** -2.5).sum()) < 1e-8
    df = spark.createDataFrame([(int(d),) for d in degrees] + [(None,), (0,)], "degree int")
    got = stats.power_law_fit(df, "degree").first()
    assert abs(got.gamma - 2.5) < 0.1 and got.n_tail <= 20_000 and got.ks < 0.02 and 0 <= got.p <= 1
    assert stats.power_law_fit(df.limit(0), "degree").collect() == []


def test_set_overlap_and_triangles(spark):
    r = random.Random(8)
    sets = {i: {r.randrange(12) for _ in range(r.randint(1, 8))} for i in range(30)}
    rows = [(i, m) for i, s in sets.items() for m in s]
    df = spark.createDataFrame(rows + rows[:20] + [(None, 3), (4, None)], "id int, m int")
    got = {x.query_id: (x.id, x.shared) for x in graphs.best_overlap(df, "id", "m", df.where("id % 3 = 0")).collect()}
    want = {}
    for q in range(0, 30, 3):
        others = [(-len(sets[q] & s) / len(sets[q] | s), i) for i, s in sets.items() if i != q and sets[q] & s]
        want[q] = (min(others)[1], len(sets[q] & sets[min(others)[1]]))
    assert got == want
    edges = {tuple(sorted(r.sample(range(14), 2))) for _ in range(40)}
    both = spark.createDataFrame([*edges, *[(b, a) for a, b in edges], (3, 3), (None, 1)], "src int, dst int")
    n = sum((a, b) in edges and (b, c) in edges and (a, c) in edges for a in range(14) for b in range(a + 1, 14) for c in range(b + 1, 14))
    degree = [sum(v in e for e in edges) for v in range(14)]
    one = graphs.triangles(both).first()
    assert one.triangles == n and abs(one.transitivity - 3 * n / sum(d * (d - 1) / 2 for d in degree)) < 1e-12
    assert graphs.triangles(both.limit(0)).first().triangles == 0


def test_newick_writer(spark):
    from sweepframe.sources import readers

    nodes = [("t", 1, None, None, None), ("t", 2, 1, 0.5, "it's a"), ("t", 3, 1, None, "b"), ("t", 4, 3, 1e-05, "x,y"), ("t", 5, 3, 2.0, None), ("t", 6, 5, 1.0, "z"), ("u", 1, None, 3.0, "only"), ("two", 1, None, 1.0, "a"), ("two", 2, None, 1.0, "b")]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, length double, label string")
    text = {x.tree: x.text for x in readers.newick_texts(df).collect()}
    assert text["t"] == "('it''s a':0.5,('x,y':1e-05,(z:1.0):2.0)b);" and text["u"] == "only:3.0;" and text["two"] is None
    back = readers.parse_newick(spark.createDataFrame([("t", text["t"])], "tree string, text string"), "tree", "text").collect()
    assert sorted((x.label or "", str(x.length)) for x in back) == sorted((n[4] or "", str(n[3])) for n in nodes[:6])
