"""Row numbers within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobloom.operators.graph import kept

c = F.col


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 1, in their key's order, which must have no ties.

    Rows are dealt by ranges of (key, order), so that a large key spreads over many tasks. Each range is numbered on its
    own, and the sizes of the ranges before, a row for each range of each key, are added.
    """
    dealt = kept(rows.repartitionByRange(c(key), *order).withColumn("range_no", F.spark_partition_id()))
    sizes = dealt.groupBy(key, "range_no").agg(F.count("*").alias("range_rows"))
    before = F.sum("range_rows").over(Window.partitionBy(key).orderBy("range_no")) - c("range_rows")
    offsets = sizes.select(c(key).alias("range_key"), c("range_no").alias("range_of"), before.alias("range_before"))
    own = F.row_number().over(Window.partitionBy(key, "range_no").orderBy(*order))
    same = c(key).eqNullSafe(c("range_key")) & (c("range_no") == c("range_of"))
    joined = dealt.withColumn("range_row", own).join(offsets, same)
    return joined.withColumn(name, (c("range_before") + c("range_row")).cast("bigint")).select(*rows.columns, name)
