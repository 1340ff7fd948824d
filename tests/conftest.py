import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (SparkSession.builder.master("local[8]").appName("caselens-tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "8g")
               .config("spark.driver.host", "127.0.0.1")
               .config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(shared))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def pairs():
    """A DataFrame's two first columns as a dict."""
    return lambda df: {r[0]: r[1] for r in df.collect()}
