"""CSV read inside files gives the rows of Spark's one-task-a-file reader."""
import os
import random

import pytest

from stagehand.sources import raw_csv, split_csv

COLUMNS = ["id", "comment", "own"]


@pytest.fixture()
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(path, rows, end, header=None):
    def cell(v, rnd):
        if any(c in v for c in ',"\n\r') or v != v.strip() or rnd.random() < 0.2:
            return '"' + v.replace('"', '""') + '"'
        return v

    rnd = random.Random(len(rows))
    text = ",".join(header or COLUMNS) + end + "".join(",".join(cell(v, rnd) for v in r) + end + (end if rnd.random() < 0.1 else "") for r in rows)
    with open(path, "wb") as f:
        f.write(text.encode())


def _rows(rnd, n):
    bits = ["a", "bb", '"', '""', "\n", "\n\n", "\r\n", ",", " ", "é", "日", "x" * 50, '\n"']
    return [[str(k), "".join(rnd.choice(bits) for _ in range(rnd.randrange(12))), rnd.choice(["1", "0", ""])] for k in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_multi_line_reader_over_split_ends(spark, tmp_dir, tiny_splits, end):
    rnd = random.Random(11)
    for f in range(3):
        _write(f"{tmp_dir}/{f}.csv", _rows(rnd, 150) + [[f"L{f}", "\n".join("line " * 30 for _ in range(40)), "1"]], end)
    want = sorted(map(tuple, raw_csv.read_csv_strings(spark, tmp_dir, COLUMNS[::-1]).collect()), key=repr)
    got = split_csv.read_csv_split(spark, tmp_dir, COLUMNS[::-1])
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert split_csv._lines(spark, tmp_dir).rdd.getNumPartitions() > 100      # many tasks of three files


def test_load_takes_the_split_reader_for_large_files(spark, tmp_dir, tiny_splits):
    os.makedirs(f"{tmp_dir}/in")
    header = ["user_id", "yearregistered", "lastlogin", "country", "stateorprovince", "traderating"]
    rows = [[f"u {k}", "2001", "2020-01-01", 'a "quoted"\nland, far', "", str(k)] for k in range(300)]
    _write(f"{tmp_dir}/in/big.csv", rows, "\n", header)
    assert raw_csv.load_raw(spark, "user_info", f"{tmp_dir}/in", f"{tmp_dir}/out") == 300
    back = spark.read.parquet(f"{tmp_dir}/out")
    assert {(r.user_id, r.country, r.stateorprovince) for r in back.collect()} == {(f"u {k}", 'a "quoted"\nland, far', None) for k in range(300)}
    plan = raw_csv.read_raw(spark, "user_info", f"{tmp_dir}/in")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan


def test_bad_files_are_refused(spark, tmp_dir, tiny_splits):
    _write(f"{tmp_dir}/a.csv", [["1", "x", "1"]], "\n")
    with pytest.raises(ValueError, match="no column other"):
        split_csv.read_csv_split(spark, tmp_dir, ["id", "other"])
    _write(f"{tmp_dir}/b.csv", [["1", "x", "1"]], "\n", ["id", "own", "comment"])
    with pytest.raises(Exception, match="another header"):
        split_csv.read_csv_split(spark, tmp_dir, COLUMNS).collect()
    _write(f"{tmp_dir}/b.csv", [["1", "x"]], "\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        split_csv.read_csv_split(spark, tmp_dir, COLUMNS).collect()
    kept = split_csv.read_csv_split(spark, tmp_dir, COLUMNS, ragged="keep").collect()
    assert sorted(map(tuple, kept), key=repr) == [("1", "x", "1"), ("1", "x", None)]
    with open(f"{tmp_dir}/b.csv", "a") as f:
        f.write('2,"open,1\n')
    with pytest.raises(ValueError, match="not closed"):
        split_csv.read_csv_split(spark, tmp_dir, COLUMNS)


def test_empty_files_and_header_only(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", [], "\n")
    assert split_csv.read_csv_split(spark, tmp_dir, COLUMNS).collect() == []
