from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TESTDATA = Path(os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import build_session
    session = build_session(
        "plumbline-tests", "local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="6g",
        spark__sql__warehouse__dir="/tmp/spark-warehouse-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
