"""First and last rows by packed orders against plain Python."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from stagehand.operators.arg_extreme import extreme_row, packed_order

SCHEMA = "k string, a long, b int, d date, t timestamp, f boolean, txt string, x double"


def _rows(n=600):
    rng = random.Random(5)
    some = lambda v: None if rng.random() < 0.15 else v
    longs = [-2**63, 2**63 - 1, -1, 0, 1, 7]
    return [(some(rng.choice("pqr")), some(rng.choice(longs)), some(rng.choice([-2**31, 2**31 - 1, 0, 3])),
             some(dt.date(1, 1, 1) + dt.timedelta(days=rng.choice([0, 800000, 3652058]))),
             some(dt.datetime(2024, 1, 1, 0, 0, 0, rng.randrange(5))), some(rng.random() < 0.5), some(f"w{i}"), float(i)) for i in range(n)]


def _key(row, cols):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return tuple((row[names.index(c)] is not None, row[names.index(c)] if row[names.index(c)] is not None else 0) for c in cols)


@pytest.mark.parametrize("order", [["a"], ["b", "d"], ["t", "f", "b"], ["f", "a", "d"]])
@pytest.mark.parametrize("last", [False, True])
def test_fixed_width_rows(spark, order, last):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = extreme_row(df, "k", order, ["a", "b", "d", "t", "f", "x"], last=last)
    assert "SortAggregate" not in plan_text(out)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {r[0] for r in rows}
    for k, r in got.items():
        mine = [x for x in rows if x[0] == k]
        best = (max if last else min)(_key(x, order) for x in mine)
        assert tuple(r[c] for c in ("a", "b", "d", "t", "f", "x")) in {
            (x[1], x[2], x[3], x[4], x[5], x[7]) for x in mine if _key(x, order) == best}   # one whole row


@pytest.mark.parametrize("last", [False, True])
def test_wide_rows_are_joined_back_once_per_key(spark, last):
    rows = _rows() * 2   # repeated rows
    out = extreme_row(spark.createDataFrame(rows, SCHEMA).repartition(5), "k", ["b", "f"], ["txt", "a"], last=last, reread=True)
    assert "SortAggregate" not in plan_text(out)
    got = out.collect()
    assert len(got) == 4 == len({r.k for r in got})
    for r in got:
        mine = [x for x in rows if x[0] == r.k]
        best = (max if last else min)(_key(x, ["b", "f"]) for x in mine)
        assert (r.txt, r.a) in {(x[6], x[1]) for x in mine if _key(x, ["b", "f"]) == best}
    again = extreme_row(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), "k", ["b", "f"], ["txt", "a"], last=last, reread=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))   # ties fall the same way


def test_orders_that_do_not_pack_and_empty_tables(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    assert packed_order(df, ["txt"]) is None and packed_order(df, ["a", "t", "f"]) is None
    assert packed_order(df, ["a", "t"]) is not None
    out = extreme_row(df, "k", ["a", "t", "x"], ["txt"])
    rows = _rows()
    for r in out.collect():
        best = min((_key(x, ["a", "t", "x"]), str(x[6])) for x in rows if x[0] == r.k)
        assert str(r.txt) == best[1]
    none = df.where(F.lit(False))
    assert extreme_row(none, "k", ["a"], ["x"]).count() == 0 == extreme_row(none, "k", ["a"], ["txt"], reread=True).count()
