"""Queries over minutes give the SQL's rows for events before 1970 too."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobloom.plans import metric_queries  # noqa: F401
from jobloom.plans.registry import SQL, queries
from tests.same_rows import compare, connect

DIR = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def early(spark, tmp_path_factory):
    """The smallest tables with all events 60 years earlier."""
    folder = tmp_path_factory.mktemp("early")
    for table in DIR.glob("*.parquet"):
        if table.name != "events.parquet":
            os.symlink(table, folder / table.name)
    moved = spark.read.parquet(str(DIR / "events.parquet")).withColumn("ts", F.expr("ts - interval 60 years"))
    moved.coalesce(1).write.parquet(str(folder / "written"))
    os.symlink(next((folder / "written").glob("*.parquet")), folder / "events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["a10_minute_buckets", "a11_merged_buckets", "t2_retained_buckets", "t25_failure_ratio"])
def test_minutes_before_1970(spark, early, name):
    assert compare(queries()[name](spark, early), connect(early), SQL[name])
