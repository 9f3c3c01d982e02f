import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro(spark):
    rows = [
        (1, "Gene network", "Gene network gene"),
        (2, "Gene map", "Cell map"),
        (3, "Cell cell", "the wall"),
    ]
    return spark.createDataFrame(rows, "id bigint, title string, abstract string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
