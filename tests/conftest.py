import pytest

from gridloom.runtime import session, ship


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, spark__sql__shuffle__partitions="4")
    ship(s)
    yield s
    s.stop()
