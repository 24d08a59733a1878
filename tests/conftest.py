import pytest

from junctura.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app="junctura-tests", driver_memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
