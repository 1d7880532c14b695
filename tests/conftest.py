import sys
from pathlib import Path

import pytest

TOP = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(TOP), str(TOP / "tests")]


@pytest.fixture(scope="session")
def spark():
    from leafmill import session

    s = session.create(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
