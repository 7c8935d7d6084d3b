import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from coffer.session import build_session

    s = build_session("coffer-tests", cpus="4", shuffle_partitions=4)
    yield s
    s.stop()


def rows(df, *order):
    """Collect as plain tuples, sorted by the given columns (or all)."""
    cols = list(order) or df.columns
    return [tuple(r) for r in df.orderBy(*cols).collect()]
