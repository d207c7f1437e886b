"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.storage import cut

#: A hub's edges are dealt to so many tasks.
SALTS = 8


def _with_smallest(edges: DataFrame) -> DataFrame:
    """Add to each edge (u, v) the smallest of u and its neighbours; a hub's edges are salted."""
    smallest = (
        edges.groupBy("u")
        .agg(F.least(F.col("u"), F.min("v")).alias("m"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(smallest, ["u", "salt"])


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _with_smallest(large)
    moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = small.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).distinct()


def _settled(edges: DataFrame) -> bool:
    """True when every u has one v and no v is a u: each component is a star around its smallest node."""
    several = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    passed_on = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
    return several.unionByName(passed_on).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Return (node, component) for every node of an edge; component is the smallest node reachable.

    Self links and repeated links are ignored, null ends too; no edges give no rows. Each round is written to the
    checkpoint folder. Only whether a round was the last comes to the driver.
    """
    a, b = F.col(src), F.col(dst)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while not _settled(now):
        now = cut(_round(now))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
