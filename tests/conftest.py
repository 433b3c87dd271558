import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from glossa.session import checkpoint_dir, get_session
    s = get_session("local[*]", 8, extra={"spark.driver.memory": "4g"})
    checkpoint_dir(s, tempfile.mkdtemp(prefix="glossa-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    from tools.oracle_check import duck as mk
    return mk(SF_ORACLE)
