import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sanscope.session import local_session

    s = local_session(8, shuffle_partitions=8, app="sanscope-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SMOKE
