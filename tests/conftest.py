import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from wavepanel.session import build_session, checkpoint_dir
    s = build_session("local[4]", partitions=4, app="wavepanel-tests")
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    """Collect a small result as a sorted list of tuples."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=none_safe)


def none_safe(t):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in t)
