import pytest


@pytest.fixture(scope="package", autouse=True)
def whole_files(spark):
    """The telemetry tests cut files into 256-byte splits; stored tables here are read whole."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
