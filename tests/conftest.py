import pytest

from quillgrid.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", 4, spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
