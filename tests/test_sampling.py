"""Seeded exact-n sampling vs brute force, stratified quotas, sample-size formula."""
import hashlib

from pyspark.sql import functions as F

from stagehand.operators import sampling


def _brute(ids, n, seed):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))[:n]


def test_seeded_sample_exact(spark):
    df = spark.range(5000).select(F.col("id").alias("uid"))
    for n, seed in [(1, 7), (37, 7), (500, 20260818), (4999, 3)]:
        got = sorted(r.uid for r in sampling.seeded_sample(df, "uid", n, seed).collect())
        assert got == sorted(_brute(range(5000), n, seed)), n
    assert sampling.seeded_sample(df, "uid", 10_000, 1).count() == 5000


def test_stratified_sample_exact(spark):
    # one stratum holds most of the rows (hot group)
    rows = [(i, "hot" if i % 10 < 7 else ("warm" if i % 10 < 9 else "cold")) for i in range(4000)]
    df = spark.createDataFrame(rows, "uid long, s string")
    sizes = {"hot": 2800, "warm": 800, "cold": 400}
    # per_bucket=7: every stratum's quota is ranked across many hash buckets
    for per_bucket in (100_000, 7):
        got = {}
        for r in sampling.stratified_sample(df, "uid", "s", 200, 42, per_bucket=per_bucket).collect():
            got.setdefault(r.s, []).append(r.uid)
        for s, size in sizes.items():
            quota = int(200 * size / 4000 + 0.5)
            members = [i for i, t in rows if t == s]
            assert sorted(got[s]) == sorted(_brute(members, quota, 42)), (s, per_bucket)


def test_sample_size_formula(spark):
    df = spark.createDataFrame([(194643,)], "N long")
    r = df.select(sampling.sample_size(F.col("N"), response_rate=0.8).alias("s")).select("s.*").first()
    assert round(r.n0) == 2401 and round(r.n_fpc) == 2372 and r.n_target == 2965.0   # ceil(2371.76 / 0.8)
    plain = df.select(sampling.sample_size(F.col("N")).alias("s")).first().s
    assert round(plain.n_target) == 2372


def test_freeze_reuses_first_draw(spark, tmp_dir):
    df = spark.range(100).select(F.col("id").alias("uid"))
    first = sampling.freeze(sampling.seeded_sample(df, "uid", 10, 1), tmp_dir + "/s")
    again = sampling.freeze(sampling.seeded_sample(df, "uid", 10, 2), tmp_dir + "/s")
    assert sorted(r.uid for r in first.collect()) == sorted(r.uid for r in again.collect())


def test_wilson(spark):
    r = spark.createDataFrame([(5, 10)], "k int, n int").select(
        sampling.wilson_interval(F.col("k"), F.col("n")).alias("w")).first().w
    assert abs(r.lo - 0.2366) < 1e-3 and abs(r.hi - 0.7634) < 1e-3


def test_seeded_sample_distributed_pick_matches(spark):
    df = spark.range(20000).select(F.col("id").alias("uid"))
    for n in (1500, 4321):
        got = sorted(r.uid for r in sampling.seeded_sample(df, "uid", n, 11, per_bucket=500).collect())
        assert got == sorted(_brute(range(20000), n, 11)), n


def test_null_ids_are_never_drawn_below_or_at_the_total(spark):
    df = spark.createDataFrame([(i if i % 2 else None, i) for i in range(10)], "uid long, x long")
    for n in (0, 3, 5, 7, 10, 20):
        got = sampling.seeded_sample(df, "uid", n, 5)
        assert got.columns == df.columns and got.count() == min(n, 5) and got.where("uid IS NULL").count() == 0
    assert sampling.seeded_sample(df.limit(0), "uid", 3, 5).count() == 0


def test_stratified_sample_with_null_strata_ends(spark):
    df = spark.createDataFrame([(i if i else None, None if i % 2 else f"s{i % 4}") for i in range(100)], "uid long, s string")
    got = {r.s: r["count"] for r in sampling.stratified_sample(df, "uid", "s", 20, 3).groupBy("s").count().collect()}
    assert got == {None: 10, "s0": 5, "s2": 5}
    assert sampling.stratified_sample(df, "uid", "s", 1000, 3, per_bucket=7).count() >= 99
