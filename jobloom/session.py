"""Spark session with the settings that the operators expect."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "jobloom", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides by name, with _ for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


#: Bytes of a batch that goes to Python, where the application names none: texts of a task stay few.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304b"


def prepare(spark: SparkSession) -> None:
    """What an application does once with its session: batches to Python of 4 MB, unless it was built with a size of its own, and the package sent to the workers."""
    if not getattr(spark, "jobloom_prepared", False):
        if spark.sparkContext.getConf().get(BATCH_KEY) is None:
            spark.conf.set(BATCH_KEY, BATCH)
        spark.jobloom_prepared = True
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once a session, so that they need no path of the driver's."""
    context = spark.sparkContext
    if getattr(context, "jobloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="jobloom-ship-")
    context.addPyFile(shutil.make_archive(f"{folder}/jobloom", "zip", package.parent, package.name))
    context.jobloom_shipped = True
