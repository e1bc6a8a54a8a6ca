"""Marts on small literal data with hand-computed answers."""
import datetime as dt

from pyspark.sql import functions as F

from stagehand.plans import marts

T0 = dt.datetime(2024, 1, 1)


def _t(h):
    return T0 + dt.timedelta(hours=h)


def test_ordered_funnel(spark):
    ev = spark.createDataFrame([
        (1, "signup", _t(0)), (1, "view", _t(1)), (1, "click", _t(2)), (1, "purchase", _t(3)),
        (2, "view", _t(0)), (2, "signup", _t(1)), (2, "click", _t(2)),      # view before signup: stops at 1
        (3, "signup", _t(0)), (3, "view", _t(5)), (3, "click", _t(1)), (3, "click", _t(6)),
        (4, "purchase", _t(0)),
    ], "u int, e string, ts timestamp")
    got = [(r.stage, r.users, r.drop_off) for r in
           marts.ordered_funnel(ev, "u", "e", "ts", ["signup", "view", "click", "purchase"]).orderBy("stage_no").collect()]
    assert got == [("signup", 3, None), ("view", 2, 1), ("click", 2, 0), ("purchase", 1, 1)]


def test_monthly_retention(spark):
    act = spark.createDataFrame([(1, dt.date(2024, 1, 5)), (1, dt.date(2024, 3, 1)), (1, dt.date(2024, 3, 9)),
                                 (2, dt.date(2024, 1, 20)), (3, dt.date(2024, 2, 2)), (3, dt.date(2024, 3, 2))],
                                "u int, d date")
    got = {(str(r.cohort_month), r.month_offset): (r.active_users, r.cohort_size, r.retention)
           for r in marts.monthly_retention(act, "u", "d").collect()}
    assert got == {("2024-01-01", 0): (2, 2, 1.0), ("2024-01-01", 2): (1, 2, 0.5),
                   ("2024-02-01", 0): (1, 1, 1.0), ("2024-02-01", 1): (1, 1, 1.0)}


def test_tertiles_keep_ties_together(spark):
    per = spark.createDataFrame([(i, t) for i, t in enumerate([0, 0, 0, 1, 2, 5, 5, 9, 30])], "u int, total int")
    seg = {r.u: r.segment for r in marts.tertile_segments(per, "u", "total").collect()}
    assert seg[0] == seg[1] == seg[2] == "light"
    assert seg[5] == seg[6] and seg[8] == "heavy"


def test_cohorts(spark):
    users = spark.createDataFrame([(2014, dt.date(2017, 1, 1)), (2014, dt.date(2014, 5, 1)), (2015, dt.date(2016, 1, 1))],
                                  "cohort int, last date")
    got = {(r.cohort, r.years_active): (r.users, r.share) for r in marts.cohort_by_year(users, "cohort", "last").collect()}
    assert got == {(2014, 3): (1, 0.5), (2014, 0): (1, 0.5), (2015, 1): (1, 1.0)}
    dist = {r.cohort: r.share for r in marts.cohort_distribution(users, "cohort").collect()}
    assert dist == {2014: 0.6667, 2015: 0.3333}


def test_wish_vs_play_and_features(spark):
    items = spark.createDataFrame([("a", 0, 3), ("b", 4, 2), ("c", 0, 0)], "k string, plays int, wish int")
    traits = spark.createDataFrame([("a", "Dice"), ("b", "Dice"), ("c", "Card")], "k string, t string")
    got = {r.t: (r.items, r.wished_unplayed, r.avg_play_to_wish) for r in
           marts.wish_vs_play(items, "k", "plays", "wish", traits, "t").collect()}
    assert got == {"Dice": (2, 1, 1.0), "Card": (1, 0, None)}
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "y"), ("b", "x")], "k string, f string")
    w = {(r.k, r.f): r.weight for r in marts.weighted_features(links, "k", "f").collect()}
    assert w == {("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "x"): 1.0}
    wide = marts.one_hot_wide(marts.weighted_features(links, "k", "f"), "k", "f", ["x", "y"])
    assert {r.k: (r.x, r.y) for r in wide.collect()} == {"a": (0.5, 0.5), "b": (1.0, 0.0)}


def test_latest_and_coverage(spark):
    df = spark.createDataFrame([("Chess", 1500, "1"), ("Chess", 2001, "2"), ("Go", 1000, "3")], "name string, y int, id string")
    got = {r.name: r.id for r in marts.latest_per_key(df, "name", ["y", "id"], ["id"]).collect()}
    assert got == {"Chess": "2", "Go": "3"}
    left = spark.createDataFrame([(i,) for i in range(4)], "k int")
    right = spark.createDataFrame([(0,), (0,), (2,)], "k int")
    r = marts.join_coverage(left, right, "k").first()
    assert (r.total, r.matched, r.unmatched, r.coverage) == (4, 2, 2, 0.5)


def test_tertiles_ranked_path_equals_percentile(spark):
    import random
    rnd = random.Random(7)
    # clustered totals with a hot value held by a third of the users
    vals = [5] * 300 + [rnd.randint(0, 40) for _ in range(500)] + [rnd.randint(10 ** 6, 10 ** 6 + 50) for _ in range(100)]
    per = spark.createDataFrame(list(enumerate(vals)), "u int, total int")
    small = {r.u: r.segment for r in marts.tertile_segments(per, "u", "total").collect()}
    ranked = {r.u: r.segment for r in marts.tertile_segments(per, "u", "total", max_exact_values=1).collect()}
    assert small == ranked


def test_exact_percentiles_match_spark_percentile(spark):
    import random
    from stagehand.operators.ranking import exact_percentiles
    rnd = random.Random(11)
    for vals in ([3], [1, 2], [rnd.choice([0, 0, 0, 1, 7, 7.5, 100]) for _ in range(999)],
                 [rnd.random() * 1000 for _ in range(2000)] + [None] * 5):
        df = spark.createDataFrame([(None if v is None else float(v),) for v in vals], "v double")
        ps = [0.0, 1.0 / 3, 0.5, 2.0 / 3, 0.99, 1.0]
        want = df.agg(F.percentile("v", ps)).first()[0]
        assert exact_percentiles(df, "v", ps, min_ranges=5) == want


def test_funnel_with_hot_user_matches_brute_force(spark, monkeypatch):
    import random
    from stagehand.operators import joins
    rnd = random.Random(3)
    stages = ["a", "b", "c"]
    # user 0 holds a third of all events
    ev = [(0 if i % 3 == 0 else rnd.randint(1, 60), rnd.choice(stages), rnd.randint(0, 500)) for i in range(3000)]

    def brute():
        users, prev = {}, None
        for k, s in enumerate(stages):
            reached = {}
            for u, e, ts in ev:
                if e == s and (k == 0 or (u in prev and ts >= prev[u])):
                    reached[u] = min(ts, reached.get(u, ts))
            users[s], prev = len(reached), reached
        return users

    df = spark.createDataFrame(ev, "u int, e string, ts int")
    want = brute()
    got = {r.stage: r.users for r in marts.ordered_funnel(df, "u", "e", "ts", stages).collect()}
    assert got == want
    # above the broadcast bound the per-user table is shuffle-joined: same answer
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", 1)
    monkeypatch.setattr(marts, "bounded_broadcast", lambda d: joins.bounded_broadcast(d, 1))
    got = {r.stage: r.users for r in marts.ordered_funnel(df, "u", "e", "ts", stages).collect()}
    assert got == want
