import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from staylens.session import build_session  # noqa: E402

TESTDATA = os.environ.get("STAYLENS_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session("staylens-tests", master="local[8]", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.path.join(TESTDATA, os.environ.get("STAYLENS_TEST_SF", "sf0.001"))


def rows(df, *order):
    """Rows as tuples, sorted, for comparing with expected lists."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((x is not None, x) for x in r))
