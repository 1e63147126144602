import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sweepframe.operators.intervals import IntervalMap, periods_and_gaps
from sweepframe.operators.ordered import chunked, last_known, previous, running_max, running_sum


def brute(rows):
    covered = {}
    for k, a, b in rows:
        if a is not None and b is not None:
            covered.setdefault(k, set()).update(range(min(a, b), max(a, b) + 1))
    out = set()
    for k, points in covered.items():
        points = sorted(points)
        runs, start = [], points[0]
        for p, q in zip(points, points[1:] + [None]):
            if q is None or q > p + 1:
                runs.append((start, p))
                start = q
        out |= {(k, "period", *r) for r in runs} | {(k, "gap", a[1] + 1, b[0] - 1) for a, b in zip(runs, runs[1:])}
    return out


@given(st.lists(st.tuples(st.integers(-30, 60), st.integers(0, 9)), min_size=1, max_size=40))
@settings(max_examples=150, deadline=None)
def test_interval_map_equals_brute_force(spans):
    m = IntervalMap()
    for s, n in spans:
        m.insert(s, s + n)
    rows = [("x", s, s + n) for s, n in spans]
    assert {("x", "period", *p) for p in m.periods()} | {("x", "gap", *g) for g in m.gaps()} == brute(rows)


@pytest.mark.parametrize("target", [100_000, 20])
def test_periods_and_gaps(spark, target):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.randint(-50, 900), r.randint(0, 12)) for _ in range(400)]
    rows = [(k, s + n, s) if r.random() < 0.2 else (k, s, s + n) for k, s, n in rows] + [("a", None, 5), ("c", 3, None), ("d", 7, 7), ("d", 7, 7), ("d", 8, 9)]
    df = spark.createDataFrame([(*t, "x") for t in rows], "gbid string, start int, `end` int, kind string")
    got = [tuple(x) for x in periods_and_gaps(df, "gbid", "start", "end", target).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "gbid string, start int, `end` int")
    assert periods_and_gaps(df, "gbid", "start", "end").collect() == []


@pytest.mark.parametrize("target", [1000, 7])
def test_previous_and_running_sum_in_chunks(spark, target):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randint(0, 30), i) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    before = {x.i: x.p.i if x.p else None for x in previous(df, ["k"], ["t", "i"], ["i"], "p", target).collect()}
    sums = {x.i: x.s for x in running_sum(df, ["k"], ["t", "i"], {"s": df.i}, target).collect()}
    for k in "ab":
        own = sorted((t, i) for kk, t, i in rows if kk == k)
        total = 0
        for n, (_, i) in enumerate(own):
            total += i
            assert before[i] == (own[n - 1][1] if n else None)
            assert sums[i] == total


@pytest.mark.parametrize("kind", ["outlier", "text", "nulls", "stamps", "fractions"])
def test_cut_groups_of_any_order_type(spark, kind):
    """Cut groups equal uncut ones, nulls come first, and no chunk is much above target whatever the values are."""
    r = random.Random(5)
    value = {"outlier": lambda i: 10**12 if i == 7 else i % 40, "text": lambda i: f"run-{i % 300:04d}", "nulls": lambda i: None if i % 3 == 0 else i, "stamps": lambda i: f"2020-01-{1 + i % 28:02d} 00:00:00", "fractions": lambda i: (i % 11) / 110}[kind]
    rows = [("hot" if i % 4 else None, value(i), i, r.choice([None, i % 10])) for i in range(2_000)]
    sql_type = {"outlier": "bigint", "nulls": "bigint", "fractions": "double"}.get(kind, "string")
    df = spark.createDataFrame(rows, f"k string, t {sql_type}, i bigint, v bigint")
    df = df.withColumn("t", df.t.cast("timestamp_ntz")) if kind == "stamps" else df
    biggest = chunked(df, ["k"], ["t", "i"], 100).rows.groupBy("k", "_chunk").count().agg({"count": "max"}).first()[0]
    assert biggest <= 200
    out = []
    for target in (100, 100_000):
        t = last_known(running_max(running_sum(previous(df, ["k"], ["t", "i"], ["i"], "p", target), ["k"], ["t", "i"], {"s": df.v}, target), ["k"], ["t", "i"], {"m": df.v}, target), ["k"], ["t", "i"], "v", "l", target)
        out.append(sorted(map(tuple, t.collect()), key=lambda x: x[2]))
    assert out[0] == out[1]
    assert sum(x[4] is None for x in out[0]) == 2


def test_release_deletes_folders(spark):
    from sweepframe.session import discard, materialise, release

    a, b = materialise(spark.range(3), "a"), materialise(spark.range(4), "b")
    where = b.inputFiles()[0].removeprefix("file://")
    discard(a)
    assert b.count() == 4 and os.path.exists(where)
    assert release(spark) >= 1 and not os.path.exists(where)
