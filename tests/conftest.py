import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weekcast.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(master="local[*]", shuffle_partitions=8)
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")
    return session


def weekly_dates(n: int, start: dt.date = dt.date(2010, 2, 5)) -> list[dt.date]:
    return [start + dt.timedelta(weeks=i) for i in range(n)]


@pytest.fixture
def make_series(spark):
    """Frame ``(key?, date, total_sales)`` from lists of values, weekly from a start date."""
    def build(values, key=None, start=dt.date(2010, 2, 5), column="total_sales"):
        dates = weekly_dates(len(values), start)
        if key is None:
            return spark.createDataFrame([(d, float(v)) for d, v in zip(dates, values)], f"date date, {column} double")
        return spark.createDataFrame([(key, d, float(v)) for d, v in zip(dates, values)],
                                     f"key string, date date, {column} double")
    return build
