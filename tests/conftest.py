import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def messy(spark):
    rows = [
        (1, 1.0, 1, "A", "X", "text1", 0),
        (2, 2.0, 2, "B", "Y", "2", 1),
        (3, None, 3, "A", None, "text3", 0),
        (4, 4.0, 4, "B", "X", "4", 1),
        (5, 5.0, 1000, "A", "Y", "5", 0),
    ]
    return spark.createDataFrame(
        rows,
        "numeric_clean long, numeric_with_nulls double, numeric_with_outliers long, "
        "categorical_clean string, categorical_with_nulls string, mixed_types string, target long",
    )


@pytest.fixture
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")
