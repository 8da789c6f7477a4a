from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from ratelake.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="ratelake-tests", shuffle_partitions=4)
    yield s
    s.stop()


def collect_sorted(df, *order):
    rows = df.orderBy(*order).collect() if order else df.collect()
    return [r.asDict(recursive=True) for r in rows]
