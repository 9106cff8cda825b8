import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "1m").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def at():
    """A time on 2024-01-02 or another day of that month, from text like 08:30 or 3 08:30."""

    def make(text: str) -> datetime:
        day, _, clock = text.rpartition(" ")
        h, m, *s = (int(x) for x in clock.split(":"))
        return datetime(2024, 1, int(day or 2), h, m, *s)

    return make
