import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from semsift.session import get_session
    s = get_session("local[4]", 8, app="semsift-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as tuples (ordered by the given columns when provided)."""
    if cols:
        df = df.orderBy(*cols)
    return [tuple(r) for r in df.collect()]
