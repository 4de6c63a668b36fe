import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy_files(tmp_path_factory):
    from toy import write_files

    return write_files(tmp_path_factory.mktemp("toy"))


@pytest.fixture(scope="session")
def toy(spark, toy_files):
    """Kept in memory, so that hundreds of small queries do not read the files anew."""
    from weft.sources.files import from_files

    return from_files(spark, toy_files).persist()
