import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimwright.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def one(spark):
    """Value of one expression over one string."""
    from pyspark.sql import functions as F

    def run(fn, value, schema="x string"):
        frame = spark.createDataFrame([(value,)], schema)
        return frame.select(fn(F.col("x")).alias("y")).first()["y"]

    return run
