import datetime as dt
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from staffmart.schema import STAGING_SCHEMA  # noqa: E402
from staffmart.session import fresh_dir, materialise  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("staffmart-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="staffmart-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def as_of():
    return dt.date(2026, 1, 15)


@pytest.fixture
def root(spark):
    return fresh_dir(spark, "mart")


@pytest.fixture
def staging(spark):
    """Build a stored staging batch from dictionaries; columns not given are NULL."""

    def build(*rows):
        columns = sorted({name for row in rows for name in row})
        types = {f.name: f.dataType.simpleString() for f in STAGING_SCHEMA.fields}
        ddl = ", ".join(f"{c} {'string' if types[c] == 'decimal(12,2)' else types[c]}" for c in columns)
        given = spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], ddl)
        return materialise(
            given.select(
                *[
                    (F.col(f.name) if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name)
                    for f in STAGING_SCHEMA.fields
                ]
            ),
            "staging",
        )

    return build
