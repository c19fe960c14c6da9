import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("CAIRNSTAT_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from cairnstat.session import build_session

    session = build_session("tests", master="local[4]", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest given tables."""
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the given tables are absent")
    return path
