"""Driver contract: entry smoke, registry shape, and every query vs its oracle on sf0.001."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from conftest import SF_SMALL, plan_text  # noqa: E402
from stagehand.plans import catalog  # noqa: E402
from stagehand.sources.testdata import TABLES  # noqa: E402
from scripts.check_oracle import digest  # noqa: E402


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["total", "matched", "unmatched", "coverage"] and len(rows) == 1
    assert rows[0].total == rows[0].matched + rows[0].unmatched


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) <= set(entry.oracle_sql())
    assert set(catalog.QUERIES) <= set(entry.queries()) and len(catalog.QUERIES) >= 70


def test_entry_without_the_training_data_part(tmp_path):
    """The rest imports and keeps its queries where that part's folders are absent."""
    import shutil
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/stagehand", tmp_path / "stagehand", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(e.llm, len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.split() == ["None", str(len(catalog.QUERIES)), str(len(catalog.ORACLE))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    plan = plan_text(sdf)
    assert "BatchEvalPython" not in plan                     # no row-at-a-time Python UDF anywhere
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert digest(sdf.columns, srows)[0] == digest(ocols, orows)[0]
