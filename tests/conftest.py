import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidecast.session import local_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture
def monthly(spark):
    """Build a panel from ``{series: values}``, months counted from January 2010."""

    def build(series):
        rows = [
            (name, date(2010 + i // 12, i % 12 + 1, 1), None if y is None else float(y))
            for name, values in series.items()
            for i, y in enumerate(values)
        ]
        return spark.createDataFrame(rows, "series_id string, ds date, y double")

    return build
