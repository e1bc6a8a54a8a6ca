"""The stored-state checklist equals the one over the raw tables, and reads no raw rows."""
import random

from stagehand.plans import check_state, warehouse
from stagehand.schemas import RAW_FIELDS


def _raw(spark, rnd, n):
    ids = [str(i) for i in range(12)] + [None, ""]
    junk = {"user_rating": ["7", "N/A", "", "11", "x", None], "yearpublished": ["1999", "", "1800", "x", None], "numowned": ["5", "x", ""],
            "rank": ["3", "Not Ranked", "", "abc", None], "avg_weights": ["2.5", "9", "", None], "ref_id": ["7", "x", None], "own": ["1", "0", None]}
    out = {}
    for t in check_state.KEYS:
        rows = [tuple(rnd.choice(ids) if c in ("user_id", "objectid") else rnd.choice(junk.get(c, ["", "a", None])) for c in RAW_FIELDS[t]) for _ in range(n)]
        out[t] = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in RAW_FIELDS[t]))
    return out


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_batches_merge_to_the_checklist_of_all_rows(spark, tmp_dir):
    rnd = random.Random(3)
    waves = [_raw(spark, rnd, n) for n in (40, 7, 25)]
    every = None
    for k, wave in enumerate(waves):
        for t, df in wave.items():
            assert check_state.load(df, t, f"{tmp_dir}/raw", f"{tmp_dir}/state", k) == df.count()
        every = wave if every is None else {t: every[t].unionByName(wave[t]) for t in every}
        want = _rows(warehouse.quality_checklist(every))
        assert _rows(check_state.checklist(spark, f"{tmp_dir}/state")) == want
    for t, df in waves[1].items():                                  # a batch loaded again replaces itself
        check_state.load(df, t, f"{tmp_dir}/raw", f"{tmp_dir}/state", 1)
    done = check_state.checklist(spark, f"{tmp_dir}/state")
    assert _rows(done) == want
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_dir}/raw" not in "".join(done.inputFiles()) and "comment" not in plan.split("blank_rate")[0]


def test_one_scan_a_table_at_the_load(spark, tmp_dir):
    """The load's own write takes all counters; the key counts read the key columns only."""
    seen = _raw(spark, random.Random(4), 20)["user_item"]
    assert check_state.load(seen, "user_item", f"{tmp_dir}/raw", f"{tmp_dir}/state", 0) == 20
    keys = spark.read.parquet(f"{tmp_dir}/raw/user_item").groupBy(*check_state.KEYS["user_item"]).count()
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:string,objectid:string>" in plan
    assert spark.read.parquet(f"{tmp_dir}/state/keys/user_item").agg({"n": "sum"}).first()[0] == 20


def test_empty_tables(spark, tmp_dir):
    empty = {t: df.limit(0) for t, df in _raw(spark, random.Random(5), 3).items()}
    for t, df in empty.items():
        check_state.load(df, t, f"{tmp_dir}/raw", f"{tmp_dir}/state", 0)
    assert _rows(check_state.checklist(spark, f"{tmp_dir}/state")) == _rows(warehouse.quality_checklist(empty))
