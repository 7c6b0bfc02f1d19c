import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quire.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="run-tests-", dir="/tmp")


@pytest.fixture(scope="session")
def duck_small():
    from oracle_compare import duck
    return duck(SMALL)
