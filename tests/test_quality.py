"""Quality checks (A1–A7, A11, J2–J4, P7–P10, T1) with SQL NULL semantics, plus plan shape."""
from pyspark.sql import functions as F

from stagehand.functions import nonblank
from stagehand.operators import quality as qa
from conftest import plan_text

RAW_ITEMS = [("1", "10", "7.5", "Not Ranked"), ("2", "", "abc", "12"), ("3", None, "8", ""),
             ("3", "2015", "N/A", "x1")]


def test_duplicates(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), (None, "1"), (None, "1")],
                               "u string, i string")
    dups = {(r.u, r.i): r.n for r in qa.duplicate_keys(df, ["u", "i"]).collect()}
    assert dups == {("a", "1"): 2, (None, "1"): 2}
    assert qa.duplicate_key_count(df, ["u", "i"]).first()[0] == 2
    assert qa.duplicate_keys(df, "u").count() == 2


def test_orphans_and_difference_null_keys(spark):
    fact = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "k string")
    dim = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    # NULL never matches: counts as orphan, exactly like LEFT JOIN ... IS NULL
    assert qa.orphan_rows(fact, dim, "k").first()[0] == 2
    row = qa.key_difference(fact, dim, "k").first()
    assert (row.in_a_not_b, row.in_b_not_a) == (2, 2)


def test_orphans_plan_is_anti_join_on_aggregates(spark):
    fact = spark.range(1000).select((F.col("id") % 7).alias("k"))
    dim = spark.range(5).select(F.col("id").alias("k"))
    df = qa.orphan_rows(fact, dim, "k")
    plan = plan_text(df)
    assert "LeftAnti" in plan
    assert "HashAggregate" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert df.first()[0] == sum(1 for i in range(1000) if i % 7 >= 5)


def test_range_violations_and_top(spark):
    df = spark.createDataFrame([(r,) for r in ["5", "11", "11", "abc", "N/A", "", None, "0.5", "abc", "abc"]],
                               "r string")
    got = [(x.r, x.n) for x in qa.range_violations(df, "r", "double", 1, 10, guard=~F.col("r").isin("N/A", "")).collect()]
    assert got == [("abc", 3), ("11", 2), ("0.5", 1)]    # NULL dropped by NOT IN, ties by value
    no_guard = {x.r: x.n for x in qa.range_violations(df, "r", "double", 1, 10).collect()}
    assert no_guard[None] == 1 and no_guard[""] == 1 and no_guard["N/A"] == 1


def test_cast_failures_and_blank_rates(spark):
    df = spark.createDataFrame(RAW_ITEMS, "objectid string, year string, average string, rank string")
    cf = qa.cast_failures(df, {"year": "int", "average": "double", "rank": "int"},
                          tokens={"rank": ["Not Ranked"]}).first()
    assert (cf.year_cast_fail, cf.average_cast_fail, cf.rank_cast_fail) == (0, 2, 1)
    br = qa.blank_rates(df, ["year", "rank"], extra={"rank_not_ranked_rate": F.col("rank") == "Not Ranked"}).first()
    assert br.year_blank_rate == 0.5 and br.rank_blank_rate == 0.25 and br.rank_not_ranked_rate == 0.25
    empty = qa.blank_rates(df.where("false"), ["year"]).first()
    assert empty.year_blank_rate is None                 # empty table: NULL, not an error


def test_group_counts_keep_null(spark):
    df = spark.createDataFrame([("1",), ("1",), (None,)], "own string")
    assert {r.own: r.n for r in qa.group_counts(df, "own").collect()} == {"1": 2, None: 1}


def test_check_suite(spark):
    df = spark.createDataFrame([("1",), ("1",)], "k string")
    suite = qa.check_suite([
        qa.check_row("dups", "duplicate_keys", qa.duplicate_key_count(df, "k", "n"), "n", expected=0),
        qa.check_row("info", "duplicate_keys", qa.duplicate_key_count(df, "k", "n"), "n"),
    ])
    rows = {r.check_id: r for r in suite.collect()}
    assert rows["dups"].value == 1.0 and rows["dups"].passed is False
    assert rows["info"].expected is None and rows["info"].passed is None
    m = qa.metrics_as_checks(qa.conditional_counts(df, {"ones": F.col("k") == "1", "blank": ~nonblank("k")}),
                             "t", expected={"blank": 0})
    got = {r.metric: (r.value, r.passed) for r in m.collect()}
    assert got == {"ones": (2.0, None), "blank": (0.0, True)}
