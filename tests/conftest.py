from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from deskstream.session import build_session

    session = build_session(
        "tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__sql__adaptive__coalescePartitions__parallelismFirst="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from deskstream.sources.bind import Inputs

    return Inputs(spark, DATA)
