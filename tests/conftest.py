import datetime as dt
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("driftmark-tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def business_days(start: dt.date, count: int, skip=()) -> list[dt.date]:
    days, day = [], start
    while len(days) < count:
        if day.weekday() < 5 and day not in skip:
            days.append(day)
        day += dt.timedelta(days=1)
    return days


def prices_from_returns(days, returns: dict[str, list[float | None]]) -> list[tuple]:
    """(ticker, date, close) rows from simple returns; the first close is 1."""
    rows = []
    for ticker, series in returns.items():
        close = 1.0
        for day, ret in zip(days, series):
            close *= 1 + ret
            rows.append((ticker, day, close))
    return rows
