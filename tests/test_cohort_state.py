"""Stored cohort bitmaps, quantile sketches and the nested funnel."""
import datetime as dt
import random

from pyspark.sql import functions as F

from stagehand.plans import cohort_state as cs
from stagehand.plans import marts


def _events(spark, rnd, n, users):
    rows = [(rnd.choice(users), dt.date(2020 + rnd.randrange(2), rnd.randrange(1, 13), rnd.randrange(1, 28))) for _ in range(n)]
    return spark.createDataFrame(rows + [(None, dt.date(2020, 1, 1)), (1, None)], "u long, d date")


def test_bitmap_retention_after_merges_equals_the_log(spark):
    rnd = random.Random(1)
    users = [rnd.randrange(200_000) for _ in range(80)] + [0, 32_768, 32_767, 10**12]
    waves = [_events(spark, rnd, 150, users) for _ in range(3)]         # later waves also bring older months
    state = cs.active_bitmaps(waves[0], "u", "d")
    for w in waves[1:]:
        state = cs.merge_bitmaps(state, cs.active_bitmaps(w, "u", "d"))
    every = waves[0].union(waves[1]).union(waves[2]).where("u IS NOT NULL AND d IS NOT NULL")
    want = sorted(map(tuple, marts.monthly_retention(every, "u", "d").collect()))
    assert sorted(map(tuple, cs.bitmap_retention(state).collect())) == want
    assert cs.bitmap_retention(cs.active_bitmaps(waves[0].limit(0), "u", "d")).collect() == []


def test_sketch_cuts_keep_their_bound_and_follow_replaced_buckets(spark):
    rnd = random.Random(2)
    rows = [(k, int(rnd.paretovariate(0.6))) for k in range(30_000)] + [(-1, None)]
    per = spark.createDataFrame(rows, "u long, t long")
    state = cs.total_sketches(per, "u", "t", buckets=16)
    cuts = cs.sketch_cuts(state, [0.1, 0.5, 0.9, 0.99])
    assert all(r.rank_error <= cs.RANK_ERROR for r in cs.rank_errors(cuts, per.where("t IS NOT NULL"), "t").collect())
    grown = per.withColumn("t", F.when(F.col("u") % 2 == 0, F.col("t") + 1000).otherwise(F.col("t")))
    state = cs.replace_sketches(state, cs.total_sketches(grown, "u", "t", buckets=16))
    cut = {r.share: r.cut for r in cs.sketch_cuts(state, [0.25, 0.75]).collect()}
    assert cut[0.25] < 1000 < cut[0.75]


def test_nested_funnel(spark):
    rows = [("a", True, 7.0, 5), ("a", True, None, 100), ("b", True, 6.0, 2), ("c", True, None, 9), ("d", False, 8.0, 4),
            ("e", True, 5.0, 0), ("f", True, 9.0, 1), ("g", None, 3.0, 3), (None, True, 1.0, 1), ("h", True, 4.0, 30)]
    got = cs.nested_funnel(spark.createDataFrame(rows, "u string, own boolean, r double, p long"), "u", "own", "r", "p").orderBy("stage_no").collect()
    # players' totals: a 105, b 2, f 1, h 30; the cut at two thirds is 30
    assert [(r.stage, r.users, r.drop_off) for r in got] == [("own", 6, None), ("rate", 5, 1), ("play", 4, 1), ("heavy", 1, 3)]
    empty = cs.nested_funnel(spark.createDataFrame([], "u string, own boolean, r double, p long"), "u", "own", "r", "p").collect()
    assert [r.users for r in sorted(empty)] == [0, 0, 0, 0]
