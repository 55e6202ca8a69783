import pytest

from cloudtally.runtime import tune
from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    s = tune(session("4"))
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
