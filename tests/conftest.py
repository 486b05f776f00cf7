import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from tickerlake import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.local_session(8, partitions=2, app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
