import decimal
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestar.__main__ import main
from lodestar.plans import catalogue, harness, profiles
from lodestar.plans.verify import assert_bag_equal, bag_difference
from lodestar.sources import files
from lodestar.sources.schemas import SSB, TPCH


def test_unknown_table(spark, sf_dir):
    with pytest.raises(KeyError):
        files.Catalog(spark, sf_dir)["lineitems"]


def test_tbl_round_trip(spark, tmp_path):
    (tmp_path / "in.tbl").write_text('1|  A "q"|x y|17|1-2|-3.50|  c|\n2|B||0||7|d|\n')
    df = files.read_tbl(spark, str(tmp_path / "in.tbl"), TPCH["supplier"], ("s_name",))
    rows = [tuple(r) for r in df.orderBy("s_suppkey").collect()]
    assert rows[0] == (1, 'A "q"', "x y", 17, "1-2", decimal.Decimal("-3.50"), "  c")
    files.write_tbl(df, str(tmp_path / "out"))
    back = files.read_tbl(spark, str(tmp_path / "out"), TPCH["supplier"])
    assert back.select("s_suppkey", "s_acctbal").collect() == df.select("s_suppkey", "s_acctbal").collect()
    (tmp_path / "bad.tbl").write_text("1|A|x|1|1|1.005|c|\n")
    with pytest.raises(Exception, match="too many digits"):
        files.read_tbl(spark, str(tmp_path / "bad.tbl"), TPCH["supplier"]).collect()
    assert len(SSB["date"]) == 17 and len(TPCH["lineitem"]) == 16


def test_cache_result_lines_and_run_log(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(80).select((F.col("id") * 7).alias("a"), F.col("id").cast("int").alias("b"))

    one, two = (files.cached(spark, str(tmp_path / "c"), make) for _ in range(2))
    assert len(made) == 1 and one.collect() == two.collect() and two.count() == 80
    files.write_result(two, str(tmp_path / "r"))
    assert "14|2" in {r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()}
    files.append_runs(spark, harness.as_rows([harness.Run("q", "p", 8, 0, "OKAY", 0.5, 10)]), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first()["status"] == "OKAY"


def test_bag_comparison(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "i int, s string")
    assert_bag_equal(a, a.select("s", "i"))
    assert bag_difference(a, a.distinct()) == [(1, "x", 1)]
    with pytest.raises(AssertionError):
        assert_bag_equal(a.limit(0), a)
    with pytest.raises(ValueError):
        bag_difference(a, a.select("i"))


def test_statuses(spark):
    slow = lambda: spark.range(10**12).select(F.sum(F.sqrt("id")))
    assert harness.run(spark, "slow", slow, timeout=2)[0].status == harness.TIMEOUT
    bad = lambda: spark.range(3).select(F.raise_error(F.lit("no")))
    assert harness.run(spark, "bad", bad)[0].status == harness.EXCEPT
    wrong = harness.run(spark, "wrong", lambda: spark.range(3), expected=spark.range(4))
    assert [r.status for r in wrong] == [harness.WRONG_RESULTS]
    good = harness.run(spark, "good", lambda: spark.range(3), repetitions=2, expected=spark.range(3), input_rows=3)
    assert [r.status for r in good] == [harness.OKAY] * 2 and "good" in harness.report(good)


@pytest.mark.parametrize("name", ["q3", "q6", "j2b", "q18", "ssb_q41", "one_join_unique_build"])
def test_profiles_never_change_results(spark, sf_dir, name):
    query = catalogue.QUERIES[name]
    want = sorted(map(tuple, query(spark, sf_dir).collect()), key=str)
    for p in [*profiles.BASE[1:], *profiles.sampled(2, seed=1)]:
        with p.on(spark):
            assert sorted(map(tuple, query(spark, sf_dir).collect()), key=str) == want
    assert spark.conf.get("spark.sql.codegen.wholeStage") == "true"


def test_variants_agree(spark, oracle_dir):
    q = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, oracle_dir).collect()), key=str) for n in ("q6", "q6a", "q6b", "q6c")}
    assert q["q6"] == q["q6a"] == q["q6b"] == q["q6c"]
    b, c = (catalogue.QUERIES[n](spark, oracle_dir).select("n_name", "r_name", "s_suppkey", "s_nationkey") for n in ("j2b", "j2c"))
    assert_bag_equal(b, c)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["q6"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(l_quantity" in plan and "GreaterThanOrEqual(l_shipdate" in plan and "l_tax" not in plan


def _plan(spark, sf_dir, name):
    return catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_parts_are_filtered_before_pairs_are_made_distinct(spark, sf_dir):
    lines = _plan(spark, sf_dir, "q9").splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-|"))
    i = next(i for i, x in enumerate(lines) if "Aggregate [l_partkey" in x or "Aggregate [ps_partkey" in x)
    below = []
    for x in lines[i + 1 :]:
        if depth(x) <= depth(lines[i]):
            break
        below.append(x)
    assert any("Contains(p_name" in x for x in below) and any("Join Inner" in x for x in below)
    assert sum("Contains(p_name" in x for x in lines) == 1


@pytest.mark.parametrize("name", ["ssb_q11", "ssb_q12", "ssb_q13", "ssb_q34", "ssb_q42"])
def test_the_star_is_read_with_a_range_of_dates(spark, sf_dir, name):
    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "l_orderkey" not in plan and "o_orderkey" not in plan  # lines and orders aren't joined again


def test_a_query_in_its_own_process(sf_dir):
    assert harness.isolated("s1", sf_dir, 2).status == harness.UNCHECKED
    crash = (sys.executable, "-c", "import os; os.abort()")
    assert harness.isolated("s1", sf_dir, 2, command=crash).status == harness.CRASH
    hang = (sys.executable, "-c", "import time; time.sleep(60)")
    assert harness.isolated("s1", sf_dir, 2, timeout=1, command=hang).status == harness.TIMEOUT


def test_timestamps_in_text(spark, tmp_path):
    (tmp_path / "t.tbl").write_text("1|1996-02-29 12:30:01|\n2|1996-02-29|\n")
    rows = files.read_tbl(spark, str(tmp_path / "t.tbl"), StructType.fromDDL("k int, at timestamp_ntz")).orderBy("k").collect()
    assert [str(r["at"]) for r in rows] == ["1996-02-29 12:30:01", "1996-02-29 00:00:00"]


def test_exploration(spark, sf_dir):
    runs = harness.explore(spark, "s1", lambda: catalogue.QUERIES["s1"](spark, sf_dir), "full", samples=2, repetitions=1)
    assert [r.status for r in runs] == [harness.OKAY] * 2
    with pytest.raises(ValueError):
        harness.explore(spark, "s1", lambda: catalogue.QUERIES["s1"](spark, sf_dir), "all")


def test_command_line(sf_dir, spark, tmp_path, capsys):
    assert main(["--data", sf_dir, "--queries", "s1,j1", "--hot-runs", "1", "--profile-log", str(tmp_path / "log"), "--result", str(tmp_path / "r")]) == 0
    assert "| s1 | default |" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--queries", "nope"])
