import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetlens.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck():
    from check_oracle import duck as make

    return make(SMALL)
