import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from molq import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "molq-tests", 4)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """rows + DDL -> DataFrame"""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
