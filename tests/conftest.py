import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stagehand.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    # tests own their session, so they set the shared folder themselves
    s = build_session("local[4]", shuffle_partitions=8, app_name="stagehand-tests",
                      checkpoint_dir=tempfile.mkdtemp(prefix="stagehand-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="stagehand-test-")


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
