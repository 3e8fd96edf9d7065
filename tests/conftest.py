import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetstops.session import build_session

    s = build_session("local[4]", 4, app="fleetstops-tests")
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    """A fresh scratch folder for one test (never reused)."""
    return tempfile.mkdtemp(prefix="fleetstops-test-")


SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
