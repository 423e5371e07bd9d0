"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from leafmill.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data() -> str:
    return DATA
