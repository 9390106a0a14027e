import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Results of a column function for Python values."""
    from pyspark.sql import functions as F

    def run(fn, *texts, kind="string"):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}").select("i", fn(F.col("t")).alias("r")).collect()
        return [r.r for r in sorted(rows, key=lambda r: r.i)]

    return run
