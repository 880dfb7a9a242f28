import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from claimlens.session import get_session
    s = get_session(master="local[8]", shuffle_partitions=8, app_name="claimlens-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
