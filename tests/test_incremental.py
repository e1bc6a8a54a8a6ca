"""A range-clustered table after waves of changes equals its full rebuild, and untouched files stay."""
import glob
import os
import random

from stagehand.operators import incremental as inc

SCHEMA = "objectid string, n int, note string"


def _files(path):
    return {os.path.relpath(f, path) for f in glob.glob(f"{path}/range=*/*.parquet")}


def _rows(spark, path):
    return sorted((tuple(r) for r in inc.read(spark, path).collect()), key=repr)


def test_waves_equal_a_full_rebuild(spark, tmp_dir):
    rnd, path = random.Random(5), f"{tmp_dir}/t"
    state = {f"{k:05d}": [(f"{k:05d}", k, "first")] for k in range(0, 4000, 2)}
    state["é日"] = [("é日", -1, "last")]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    inc.build(df([r for v in state.values() for r in v]), "objectid", path, rows_per_range=300)
    first = _files(path)
    assert len({f.split("/")[0] for f in first}) >= 6
    for wave in range(3):
        low = 700 * wave
        keys = [f"{rnd.randrange(low, low + 500):05d}" for _ in range(60)]
        changed = {k: [] if k.endswith("4") else [(k, j, f"wave {wave}") for j in range(rnd.randrange(1, 4))] for k in keys}
        before = _files(path)
        written = inc.refresh(path, "objectid", df([(k, None, None) for k in changed]), df([r for v in changed.values() for r in v]), 300)
        state.update(changed)
        assert _rows(spark, path) == sorted((r for v in state.values() for r in v), key=repr)
        kept = {f for f in before if int(f.split("/")[0].split("=")[1]) not in written}
        assert kept and kept <= _files(path)                       # not touched: the same files
    assert first & _files(path)


def test_growth_hot_keys_and_emptied_ranges(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    inc.build(df([(f"k{i:03d}", i, "a") for i in range(100)]), "objectid", path, rows_per_range=50)
    more = [(f"k{i:03d}x{j:02d}", j, "b") for i in range(10) for j in range(60)] + [("k050", j, "hot") for j in range(500)]
    inc.refresh(path, "objectid", df(more), df(more), 50)
    want = [(f"k{i:03d}", i, "a") for i in range(100) if i != 50] + more
    assert _rows(spark, path) == sorted(want, key=repr)
    bounds = inc._read_bounds(spark, path)
    assert len(bounds) > 8                                          # large ranges were cut
    gone = df([(f"k{i:03d}", 0, "") for i in range(60, 100)])
    inc.refresh(path, "objectid", gone, gone.limit(0), 50)
    want = [r for r in want if not (r[2] == "a" and r[1] >= 60)]
    assert _rows(spark, path) == sorted(want, key=repr)
    one = df([("k001", 0, "")])
    assert sorted(map(tuple, inc.rows_of(spark, path, one, "objectid").collect())) == [("k001", 1, "a")]
    assert inc.refresh(path, "objectid", one.limit(0), one.limit(0), 50) == []


def test_a_run_that_died_between_bounds_and_folders_is_repeated(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/t"
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    inc.build(df([(f"k{i:03d}", i, "a") for i in range(100)]), "objectid", path, rows_per_range=100)
    more = [(f"m{i:03d}", i, "b") for i in range(300)]
    real = inc._write
    monkeypatch.setattr(inc, "_write", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        inc.refresh(path, "objectid", df(more), df(more), 100)
        raise AssertionError("the run should have died")
    except RuntimeError:
        pass
    monkeypatch.setattr(inc, "_write", real)
    inc.refresh(path, "objectid", df(more), df(more), 100)
    assert _rows(spark, path) == sorted([(f"k{i:03d}", i, "a") for i in range(100)] + more, key=repr)
