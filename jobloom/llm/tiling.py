"""Deal the members of candidate buckets to bounded tiles, so that no bucket meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.storage import cut

#: Large buckets' members are dealt to so many tasks where their list is joined by a shuffle.
SALTS = 8
#: So many large buckets are listed to every task; beyond, rows and list are shuffled.
BROADCAST_BUCKETS = 50_000


def tiles(rows: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """Rows in tiles: columns of rows, then part, tile_a and tile_b, sorted by tile in each partition.

    A bucket (equal keys) of more than chunk members is split by a hash of member into parts; each two parts meet in
    the tile (tile_a, tile_b), and each part in its own tile (p, p). Every pair of a bucket so meets, and a tile holds
    about two chunks at most.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("members")).where(F.col("members") > chunk)
    large = cut(counts.select(*keys, F.ceil(F.col("members") / chunk).cast("int").alias("parts")))
    if large.count() <= BROADCAST_BUCKETS:
        marked = rows.join(F.broadcast(large), keys, "left")
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64(member, F.lit(11)), F.lit(SALTS)).cast("int"))
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = salted.join(spread, [*keys, "salt"], "left").drop("salt")
    dealt = marked.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn(
        "part", F.pmod(F.xxhash64(member, F.lit(7)), F.col("parts")).cast("int")
    )
    return (
        dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("tile_a", F.least("part", "other"))
        .withColumn("tile_b", F.greatest("part", "other"))
        .drop("parts", "other")
        .repartition(*keys, "tile_a", "tile_b")
        .sortWithinPartitions(*keys, "tile_a", "tile_b")
    )


def contracted(stars: DataFrame, member: str, root: str) -> DataFrame:
    """Fewer links (member, root) of the same components: each member keeps its smallest root, which takes its others.

    A member has one root, no larger than itself, in each tile that it stands in, so no more roots than tiles.
    """
    roots = stars.groupBy(member).agg(F.min(root).alias("least"), F.collect_set(root).alias("roots"))
    own = roots.select(F.col(member), F.col("least").alias(root))
    others = roots.where(F.size("roots") > 1).select(F.explode("roots").alias(member), F.col("least").alias(root))
    return own.unionByName(others).where(F.col(member) != F.col(root)).distinct()


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that each table holds whole tiles."""
    kept: list[pa.RecordBatch] = []
    by = [*keys, "tile_a", "tile_b"]
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1] for k in by]
        first = batch.num_rows - 1
        columns = [batch.column(k) for k in by]
        same = None
        for column, value in zip(columns, last, strict=True):
            hit = pc.equal(column, value).to_numpy(zero_copy_only=False)
            same = hit if same is None else same & hit
        first = int(same.argmax())
        if first == 0 and kept and all(kept[-1].column(k)[-1] == v for k, v in zip(by, last, strict=True)):
            kept.append(batch)
            continue
        whole = [*kept, batch.slice(0, first)]
        table = pa.Table.from_batches(whole)
        if table.num_rows:
            yield table
        kept = [batch.slice(first)]
    if kept:
        yield pa.Table.from_batches(kept)
