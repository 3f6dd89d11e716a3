import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tenderloom.session import local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Limits so low that the path for many questions is taken, and ranges so many that every group is cut."""
    limits = {"query.block": 3, "index.block": 50}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for name, value in limits.items():
        spark.conf.set(f"spark.tenderloom.{name}", value)
    yield spark
    for name in limits:
        spark.conf.unset(f"spark.tenderloom.{name}")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def column_of(spark):
    """Values of an expression over a list of strings."""

    def run(values, expression):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").coalesce(1)
        return [r[0] for r in rows.select(expression(F.col("s")).alias("v"), "i").orderBy("i").select("v").collect()]

    return run
