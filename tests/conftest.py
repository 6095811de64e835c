import pytest

from tidegrid.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
