"""Joins of rows with facts about their keys, where a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key of more rows than this is hot, and at most one in HOT_KEYS of all rows.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


def attached(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined with facts by key; facts has one row a key, and in weight how many rows the key has or had.

    Facts of hot keys are sent to every task, the others' meet their rows in a shuffle. As the weights add up to a
    total, and a hot key has more than a HOT_KEYS-th of it, no more than HOT_KEYS facts are sent.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    bound = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col(weight) > bound))
    cold = facts.where(F.col(weight) <= bound)
    rest = rows.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return rows.join(hot, key).unionByName(rest)
