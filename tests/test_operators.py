"""Single operators on small frames, against what plain Python makes of the same rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar.functions import exprs as X
from lodestar.operators.relational import AGGREGATES, ORDERED, aggregate, global_aggr, hash_aggr, hash_join, project, scan, select, semi_join, tap


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def drawn(seed, n, *ranges):
    """n rows of whole numbers below the ranges."""
    r = random.Random(seed)
    return [tuple(r.randrange(x) for x in ranges) for _ in range(n)]


def joined(probe, build):
    """Inner join on the first column of both, by nested loops."""
    return sorted((*p, *b) for p in probe for b in build if p[0] == b[0])


@pytest.fixture(scope="module")
def build(spark):
    return spark.createDataFrame([(2, 52), (5, 55), (6, 56), (9, 59)], "k int, v int")


@pytest.mark.parametrize("seed,probes,builds,keys", [(1, 40, 12, 15), (2, 300, 40, 9), (3, 50, 1, 4), (4, 25, 25, 1000)])
def test_inner_join(spark, seed, probes, builds, keys):
    p, b = drawn(seed, probes, keys), drawn(seed + 100, builds, keys, 1000)
    out = hash_join(spark.createDataFrame(p, "b int"), ["b"], spark.createDataFrame(b, "k int, v int"), ["k"], ["v"])
    assert out.columns == ["b", "k", "v"] and bag(out) == joined(p, b)


def test_single_match_and_semi(spark):
    p, b = drawn(7, 60, 14), drawn(8, 90, 20, 50)
    probe, table = spark.createDataFrame(p, "b int"), spark.createDataFrame(b, "k int, v int")
    least = {}
    for k, v in b:
        least[k] = min(v, least.get(k, v))
    assert bag(hash_join(probe, ["b"], table, ["k"], ["v"], unique_build=True)) == sorted((x, x, least[x]) for (x,) in p if x in least)
    assert bag(hash_join(probe, ["b"], table, ["k"], unique_build=True)) == sorted((x, x) for (x,) in p if x in least)
    assert bag(semi_join(probe, ["b"], table, ["k"])) == sorted((x,) for (x,) in p if x in least)


def test_joins_with_filters(spark):
    p, b = drawn(9, 80, 30), drawn(10, 40, 30, 200)
    probe, table = spark.createDataFrame(p, "b int"), spark.createDataFrame(b, "k int, v int")
    assert bag(hash_join(probe, ["b"], select(table, F.col("v") > 120), ["k"], ["v"])) == joined(p, [x for x in b if x[1] > 120])
    assert bag(hash_join(select(probe, F.col("b") < 11), ["b"], table, ["k"], ["v"])) == joined([x for x in p if x[0] < 11], b)


def test_composite_keys_and_errors(spark):
    left, right = drawn(11, 60, 4, 3, 100), drawn(12, 30, 4, 3, 100)
    a, b = spark.createDataFrame(left, "x int, y int, z int"), spark.createDataFrame(right, "p int, q int, r int")
    assert bag(hash_join(a, ["x", "y"], b, ["p", "q"], ["r"])) == sorted((*u, *w) for u in left for w in right if u[:2] == w[:2])
    for keys in (["p"], []):
        with pytest.raises(ValueError):
            hash_join(a, ["x", "y"][: len(keys) and 2], b, keys)


def test_groups(spark):
    rows = drawn(13, 500, 6, 5, 90)
    df = spark.createDataFrame(rows, "k1 long, k2 int, v long")
    for limit in (1000, 40):
        want = defaultdict(list)
        for a, b, v in rows:
            if v < limit:
                want[a, b].append(v)
        got = hash_aggr(select(df, F.col("v") < limit), ["k1", "k2"], {"s": F.sum("v"), "n": ("count",), "low": ("min", "v"), "high": ("max", "v")})
        assert bag(got) == sorted((*k, sum(v), len(v), min(v), max(v)) for k, v in want.items())
    assert bag(hash_aggr(df, ["k1"], {"n": ("count",), "one": ("const1",)})) == sorted((k, n, 1) for k, n in Counter(r[0] for r in rows).items())
    assert bag(hash_aggr(df, ["k2"])) == sorted({(r[1],) for r in rows})
    small = [(1, 2.0), (1, 4.0), (2, 0.5)]
    assert bag(hash_aggr(spark.createDataFrame(small, "k int, x double"), ["k"], {"p": ("product", "x")})) == [(1, 8.0), (2, 0.5)]


@pytest.mark.parametrize("kind", [*ORDERED, "median", "SUM", ""])
def test_unknown_aggregates_are_errors(kind):
    with pytest.raises(ValueError):
        aggregate(kind, "v")


@pytest.mark.parametrize("kind", sorted(AGGREGATES))
def test_wrong_numbers_of_arguments_are_errors(build, kind):
    with pytest.raises(ValueError):
        hash_aggr(build, ["k"], {"x": (kind, "v", "k")})
    with pytest.raises(ValueError):
        global_aggr(build, {"x": (kind, *(["v"] if AGGREGATES[kind][1] == 0 else []))})


def test_global_aggregate_over_nothing(spark, build):
    none = select(build, F.col("k") < 0)
    assert bag(global_aggr(none, {"n": ("count",)})) == []
    assert bag(global_aggr(none, {"n": F.count(F.lit(1))}, empty_row=True)) == [(0,)]
    assert bag(global_aggr(build, {"s": X.exact_sum(F.col("v"), 0)})) == [(52 + 55 + 56 + 59,)]


def test_tap_counts_what_streams_by(spark, build):
    rows, seen = tap(select(build, F.col("k") > 2), "some", most=("max", "v"))
    assert bag(rows) == [(5, 55), (6, 56), (9, 59)] and seen.get == {"rows": 3, "most": 59}


def test_empty_inputs(spark, build):
    none = select(build, F.lit(False))
    assert bag(hash_join(none, ["k"], build, ["k"])) == bag(hash_join(build, ["k"], none.toDF("k2", "v2"), ["k2"])) == []
    assert bag(hash_aggr(none, ["k"], {"n": F.count(F.lit(1))})) == bag(hash_aggr(none, ["k"])) == []
    assert scan(none, ["v"]).columns == ["v"]


def test_projection_sees_its_own_items(spark, build):
    assert bag(project(build, "k", ("w", F.col("v") + 1), ("x", F.col("w") * 2))) == [(k, v + 1, 2 * v + 2) for k, v in [(2, 52), (5, 55), (6, 56), (9, 59)]]


def test_date_comparison(spark):
    days = ["2003-02-28", "2004-02-29", "2003-03-01", "1969-12-31", "2004-02-29"]
    df = spark.createDataFrame(list(enumerate(days)), "i int, d string").withColumn("d", F.col("d").cast("timestamp_ntz"))
    for border in sorted(set(days)):
        assert [r[0] for r in bag(select(df, F.col("d") >= X.day(border)))] == [i for i, d in enumerate(days) if d >= border]
    row = df.select(X.julian_day(F.lit("1970-01-02").cast("date")), X.from_julian_day(F.lit(2440587)).cast("string"), X.year(F.col("d"))).first()
    assert tuple(row) == (2440589, "1969-12-31", 2003)


def test_money(spark):
    df = spark.createDataFrame([(-0.0,), (0.03,), (2.45,), (-1.05,), (90071.25,)], "x double")
    assert [r[0] for r in df.select(X.scaled(F.col("x"))).collect()] == [0, 3, 245, -105, 9007125]
    big = spark.range(3).select(F.lit(2**62).alias("v"))
    assert str(big.agg(X.exact_sum(F.col("v"), 2)).first()[0]) == str(3 * 2**62)[:-2] + "." + str(3 * 2**62)[-2:]
    assert df.agg(X.exact_sum(X.scaled(F.col("x")), 2).cast("string")).first()[0] == "90072.68"
    pairs = [(a, b) for a in (-9, -1, 0, 8) for b in (-4, 3)]
    signed = spark.createDataFrame(pairs, "a long, b long")
    assert [r[0] for r in signed.select(X.divide_scaled(F.col("a"), F.col("b"))).collect()] == [int(a / b) for a, b in pairs]
    assert [r[0] for r in signed.select(X.truncated(F.col("a") * 13, 1)).collect()] == [int(a * 13 / 10) for a, _ in pairs]


def test_text_predicates(spark):
    texts = ["50%_off", "off 50", "xoffx", "%", "of f", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for needle in ("%_", "off", "f", "50"):
        assert bag(select(df, X.contains(F.col("s"), needle))) == sorted((t,) for t in texts if needle in t)
    assert bag(select(df, X.contains_in_order(F.col("s"), "5", "off"))) == [("50%_off",)]
    for op, holds in (("eq", lambda t, v: t == v), ("lt", lambda t, v: t < v), ("ge", lambda t, v: t >= v)):
        assert bag(select(df, X.one_of(F.col("s"), op, "of f", "xoffx"))) == sorted((t,) for t in texts if holds(t, "of f") or holds(t, "xoffx"))


def test_hashes_and_numbers(spark):
    df = spark.createDataFrame([(a, b) for a in range(40) for b in range(40)], "a int, b int")
    hashed = df.select(X.rehash(X.hash_of(F.col("a")), F.col("b")).alias("h"))
    assert hashed.distinct().count() == 1600 and bag(hashed) == bag(df.repartition(3).select(X.rehash(X.hash_of(F.col("a")), F.col("b"))))
    assert df.repartition(5).select(X.sequence().alias("n")).distinct().count() == 1600
