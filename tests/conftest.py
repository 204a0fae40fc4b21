import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = os.environ.get("CHRONOWEAVE_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from chronoweave.session import build
    s = build("local[8]", 4, memory="6g", app="chronoweave-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
