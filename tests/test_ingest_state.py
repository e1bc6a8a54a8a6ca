"""Work lists, triage, ledger, partial failures, first-seen, completeness, batching, progress."""
from pyspark.sql import functions as F

from stagehand.operators import ingest_state as ing


def test_triage_cases(spark):
    cases = [(401, 1, None, True), (429, 2, 7.0, True), (429, 3, None, True), (202, 1, None, True),
             (404, 1, None, True), (500, 4, None, True), (None, 2, None, True), (200, 1, None, False),
             (200, 1, None, True), (503, 5, None, True)]
    df = spark.createDataFrame(cases, "status int, attempt int, ra double, ok boolean")
    got = [tuple(r) for r in df.select(ing.triage(F.col("status"), F.col("attempt"), F.col("ra"), F.col("ok"))
                                         .alias("t")).select("t.*").collect()]
    assert got == [("abort", None, "http_401"), ("retry", 7.0, "http_429"), ("retry", 8.0, "http_429"),
                   ("retry", 2.0, "http_202"), ("failed", None, "http_404"), ("retry", 16.0, "http_500"),
                   ("retry", 4.0, "network"), ("retry", 2.0, "bad_body"), ("ok", None, None),
                   ("failed", None, "exhausted:http_503")]


def test_todo_and_ledger(spark):
    cand = spark.createDataFrame([(str(i),) for i in range(6)], "u string")
    done = spark.createDataFrame([("0",), ("1",), ("1",)], "u string")
    failed = spark.createDataFrame([("2",), ("9",)], "u string")
    assert sorted(r.u for r in ing.todo_ids(cand, done, failed, "u").collect()) == ["3", "4", "5"]
    ledger = spark.createDataFrame([("a", "retry", "x", 1), ("a", "done", None, 3), ("b", "failed", "http_404", 2)],
                                   "unit_id string, state string, reason string, batch_id int")
    st = {r.unit_id: (r.state, r.reason) for r in ing.latest_state(ledger).collect()}
    assert st == {"a": ("done", None), "b": ("failed", "http_404")}
    plays = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "unit_id string, play int")
    tagged = {r.play: r.is_complete for r in ing.tag_partial(plays, ing.latest_state(ledger), "unit_id").collect()}
    assert tagged == {1: True, 2: False, 3: False, 4: None}     # rows of a failed unit stay, tagged


def test_exclusions_truncate(spark):
    df = spark.createDataFrame([("u1", "failed", "x" * 500), ("u2", "ok", None)], "u string, state string, reason string")
    r = ing.exclusions(df, "u").collect()
    assert len(r) == 1 and len(r[0].reason) == 200


def test_first_seen(spark):
    df = spark.createDataFrame([("10", 2, 0, "late"), ("10", 1, 5, "first"), ("10", 1, 6, "second"), ("11", 3, 0, "only")],
                               "objectid string, unit_seq int, pos int, name string")
    got = {r.objectid: r.name for r in ing.first_seen(df, "objectid", ["unit_seq", "pos"], keep=["name"]).collect()}
    assert got == {"10": "first", "11": "only"}


def test_page_completeness(spark):
    pages = spark.createDataFrame([("u1", 1, 100, 150), ("u1", 2, 50, 150), ("u2", 1, 100, 300), ("u3", 1, 0, 10)],
                                  "u string, page int, rows int, total int")
    got = {r.u: (r.rows_gathered, r.rows_declared, r.is_complete) for r in
           ing.page_completeness(pages, "u", "page", "rows", "total").collect()}
    assert got == {"u1": (150, 150, True), "u2": (100, 300, False), "u3": (0, 10, True)}


def test_global_index_and_batches_match_brute_force(spark):
    ids = [i * i % 10007 for i in range(3000)]
    uniq = sorted(set(ids))
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    idx = {r.k: r._idx for r in ing.global_index(df.distinct(), "k", min_ranges=37).collect()}
    assert idx == {k: i for i, k in enumerate(uniq)}
    # clustered keys: a dense block holding most rows, plus far outliers
    keys = list(range(10 ** 12, 10 ** 12 + 2000)) + [1, 2, 3, 2 ** 62]
    kdf = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r._idx for r in ing.global_index(kdf, "k", rows_per_range=100, min_ranges=4).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
    batches = {r.batch_no: (r.n_ids, r.ids) for r in ing.id_batches(df, "k", 20).collect()}
    expect = {b: (len(uniq[b * 20:(b + 1) * 20]), ",".join(map(str, uniq[b * 20:(b + 1) * 20])))
              for b in range((len(uniq) + 19) // 20)}
    assert batches == expect


def test_progress(spark):
    sample = spark.createDataFrame([(str(i),) for i in range(10)], "u string")
    done = spark.createDataFrame([("0",), ("1",), ("2",), ("99",)], "u string")
    excl = spark.createDataFrame([("3",), ("2",)], "u string")
    dur = spark.createDataFrame([("0", 10.0), ("1", 20.0), ("5", 99.0)], "u string, seconds double")
    r = ing.progress(sample, done, excl, "u", dur, "seconds").first()
    assert (r.sampled, r.processed, r.excluded, r.remaining) == (10, 3, 1, 6)
    assert r.sec_per_unit == 15.0 and r.eta_seconds == 90.0


def test_append_unit_rows_is_replay_safe(spark, tmp_dir):
    b1 = spark.createDataFrame([("u1", 1, 7), ("u1", 2, 7)], "user_id string, pos int, batch_id int")
    b2 = spark.createDataFrame([("u2", 1, 8)], "user_id string, pos int, batch_id int")
    ing.append_unit_rows(b1, tmp_dir + "/rows")
    ing.append_unit_rows(b2, tmp_dir + "/rows")
    ing.append_unit_rows(b1, tmp_dir + "/rows")              # the same unit replayed after a crash
    assert spark.read.parquet(tmp_dir + "/rows").count() == 3


def test_requested_not_returned(spark):
    req = spark.createDataFrame([(1, "10"), (1, "11"), (1, "12"), (2, "13")], "batch int, oid string")
    ret = spark.createDataFrame([(1, "10"), (1, "12"), (2, "13"), (2, "10")], "batch int, oid string")
    got = sorted(tuple(r) for r in ing.requested_not_returned(req, ret, "oid", "batch").collect())
    assert got == [(1, "11")]


def test_ranges_stay_balanced_when_keys_cluster(spark):
    from pyspark.sql import functions as F
    from stagehand.operators.ranking import ranged
    # 3000 keys packed in a tiny block plus a few far outliers: equal-width cuts would
    # put nearly all rows in one range; the sampled range cut keeps every range small
    keys = list(range(5 * 10 ** 9, 5 * 10 ** 9 + 3000)) + [0, 1, 10 ** 15]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    r = ranged(df, "k", rows_per_range=300)
    sizes = [row.n for row in r.groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == len(keys) and len(sizes) >= 8
    assert max(sizes) <= 3 * 300
    # ranges are in key order: every key of range i is below every key of range i+1
    bounds = sorted((row.lo, row.hi) for row in r.groupBy("_r").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def test_batches_of_string_ids_follow_string_order(spark):
    ids = [f"user-{i}" for i in range(137)] + ["user-5", "user-77"]          # repeats are batched once
    df = spark.createDataFrame([(i,) for i in ids], "u string")
    uniq = sorted(set(ids))
    got = {r.batch_no: r.ids for r in ing.id_batches(df, "u", 20).collect()}
    assert got == {b: ",".join(uniq[b * 20:(b + 1) * 20]) for b in range((len(uniq) + 19) // 20)}
