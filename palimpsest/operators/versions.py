"""Versioned rows: latest, as-of, merge and overlay, all by partial aggregation on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: str | list[str] = "txid") -> DataFrame:
    """Of each key the row with the greatest ``order``. Sums run map-side; one shuffle, of one row a key and task."""
    order = [order] if isinstance(order, str) else order
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest)).select(*log.columns)


def as_of_txid(log: DataFrame, keys: list[str], txid: int) -> DataFrame:
    """State after transaction ``txid``; the filter reaches the scan."""
    return latest(log.where(F.col("txid") <= txid), keys)


def as_of_time(log: DataFrame, keys: list[str], ts: Column, column: str = "ts") -> DataFrame:
    """State at time ``ts``, both ends included."""
    return latest(log.where(F.col(column) <= ts), keys)


def merged(inputs: list[DataFrame], commits: list[int], key: str = "pgno") -> DataFrame:
    """Merge of page sets (key, data), oldest first: the last version of each page.

    An input that shrinks the database ends all older pages beyond its size, even if a later one grows it again.
    """
    parts = []
    for i, (df, commit) in enumerate(zip(inputs, commits, strict=True)):
        parts.append(df.where(F.col(key) <= min(commits[i:])).select(key, "data", F.lit(i).alias("step")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return latest(every, [key], "step")


def overlaid(base: DataFrame, changes: DataFrame, commit: int, page_size: int, key: str = "pgno", blank: Column | None = None) -> DataFrame:
    """Pages 1 to ``commit`` without the lock page: the change if there is one, else the base page, else a blank."""
    lock = 0x40000000 // page_size + 1
    spine = base.sparkSession.range(1, commit + 1).select(F.col("id").alias(key)).where(F.col(key) != lock)
    new = changes.select(key, F.col("data").alias("new_"))
    old = base.select(key, F.col("data").alias("old_"))
    return spine.join(new, key, "left").join(old, key, "left").select(key, F.coalesce("new_", "old_", F.lit(bytes(page_size)) if blank is None else blank).alias("data"))


def newest_first(steps: list[DataFrame], keys: list[str]) -> DataFrame:
    """Of each key the row of the first step that has it, given newest first; each step has one row a key. One union, one aggregate."""
    every = steps[0].withColumn("step_", F.lit(0))
    for i, s in enumerate(steps[1:], 1):
        every = every.unionByName(s.withColumn("step_", F.lit(-i)))
    return latest(every, keys, "step_").drop("step_")
