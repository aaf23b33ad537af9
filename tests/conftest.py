import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tablemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.session.timeZone", "UTC")
    yield session


@pytest.fixture
def tiny_slices(spark):
    """Every group above 40 rows counts as hot."""
    spark.conf.set("tablemill.rowsPerSlice", "40")
    yield spark
    spark.conf.unset("tablemill.rowsPerSlice")
