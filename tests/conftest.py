import pytest

from millrace.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", "4g", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()
