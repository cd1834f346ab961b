import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tallymill.session import local_session

    s = local_session(4, memory="4g", partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
