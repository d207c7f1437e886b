"""Where intermediate tables go: the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; on one machine, where it is unset, a temporary one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="jobloom-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return str(spark.sparkContext.getCheckpointDir())


#: Tables written inside the open scratch blocks, innermost last.
_OPEN: list[list[str]] = []


def cut(df: DataFrame, outlast: bool = False) -> DataFrame:
    """Write df to a table in the checkpoint folder and go on from there, so that a lost executor costs one stage only.

    With outlast the table stays when the innermost scratch block ends.

    A table and not a checkpoint: it is compressed, later reads take the columns they need, and what the optimizer has
    inferred about rows does not pile up over rounds.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    holders = _OPEN[:-1] if outlast else _OPEN
    if holders:
        holders[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that operators write inside the block when it ends; their results must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            discard(spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table that is no longer needed."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
