import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tastemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tastemill-tests")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return "/root/testdata/sf0.001"
