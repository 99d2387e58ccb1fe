import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def salting(monkeypatch):
    """Any key with two rows is hot, so that the salted plans run on small data."""
    from provgraph.functions import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 1)
    monkeypatch.setattr(skew, "ROWS_PER_BLOCK", 2)


def day(n: int) -> dt.datetime:
    return dt.datetime(2025, 1, 1) + dt.timedelta(days=n)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
