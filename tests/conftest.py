import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("ITEMSPACE_DRIVER_MEM", "4g")
    from itemspace.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="itemspace-tests")
    yield s
    s.stop()
