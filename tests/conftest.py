from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__  # noqa: E402,F401
from wayline.session import local_session  # noqa: E402
from wayline.streaming.session_tracker import ROCKSDB  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4, spark__sql__streaming__stateStore__providerClass=ROCKSDB)
    yield session
    session.stop()
