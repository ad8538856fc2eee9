import pytest

from paperloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", cores=4, spark__driver__memory="3g")
