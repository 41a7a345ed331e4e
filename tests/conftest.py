import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sellerlens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="sellerlens-tests")
    yield s


def rows(df, *cols):
    """Collected values of ``cols`` (all columns if none) as tuples."""
    cols = cols or tuple(df.columns)
    return [tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
