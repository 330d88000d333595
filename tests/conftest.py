from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quarryspan.session import local_session, with_package  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = with_package(local_session(4, partitions=4, memory="4g"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    if not Path(DATA).exists():
        pytest.skip("no test data here")
    return DATA
