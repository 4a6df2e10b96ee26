import tempfile

import pytest
from pyspark.sql import SparkSession

# made at import, so that test modules may build Columns when they are collected
_SPARK = (
    SparkSession.builder.master("local[4]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false")
    .config("spark.ui.showConsoleProgress", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "4g")
    .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
    .getOrCreate()
)
_SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return _SPARK
