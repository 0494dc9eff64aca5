import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskweave.session import HOT_GROUP_ROWS, configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]").appName("riskweave-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Treat every group above 20 rows as hot, so that the segmented paths run on small data."""
    spark.conf.set(HOT_GROUP_ROWS, "20")
    yield 20
    spark.conf.unset(HOT_GROUP_ROWS)
