import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tarmac.session import build_session

    s = build_session("local[4]", 4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def with_aggs(spark):
    from tarmac.plans import stages

    return stages.with_aggregates(spark, SF_SMALL)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]
