import pytest

from tests.harness import ROOT, duck, session


@pytest.fixture(scope="session")
def spark():
    return session(8)


@pytest.fixture(scope="session")
def sf_dir():
    return f"{ROOT}/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    return duck(sf_dir)
