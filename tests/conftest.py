import pytest
from pyspark.sql import SparkSession

from plumbline.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = get_spark(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
