"""WAL frames as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def committed(frames: DataFrame, order: str = "frame_no", commit: Column | None = None, ok: Column | None = None) -> DataFrame:
    """Frames of the valid prefix up to its last commit, with ``commit_size``, the database's size after it.

    One aggregate finds the first bad frame and the last commit; only where a frame is bad, a second one over what is before it
    finds that part's last commit. Both give one row, and their values reach the scan as a filter. No ordered window over the log.
    """
    commit = F.col("commit") if commit is None else commit
    ok = F.coalesce(F.col("ok") if ok is None else ok, F.lit(False))
    at = F.when(commit != 0, F.col(order))
    last = [F.max(at).alias("last"), F.max_by(commit, at).alias("size")]
    got = frames.agg(F.min(F.when(~ok, F.col(order))).alias("bad"), *last).first()
    if got["bad"] is not None:
        got = frames.where(F.col(order) < F.lit(got["bad"])).agg(*last).first()
    if got["last"] is None:
        return frames.withColumn("commit_size", commit).where(F.lit(False))
    return frames.where(F.col(order) <= F.lit(got["last"])).withColumn("commit_size", F.lit(got["size"]))


def page_map(frames: DataFrame, order: str = "frame_no", key: str = "pgno", value: str = "data", **how) -> DataFrame:
    """(key, order, value): of each page the newest committed frame, without pages beyond the final size."""
    log = committed(frames, order, **how)
    return log.where(F.col(key) <= F.col("commit_size")).groupBy(key).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))


def gaps(files: DataFrame) -> DataFrame:
    """Neighbours of one level that leave a gap or don't advance: adds prev_max and ``broken``; a window a level, over catalog rows."""
    w = Window.partitionBy("level").orderBy("min_txid", "max_txid")
    return files.withColumn("prev_max", F.lag("max_txid").over(w)).where("prev_max is not null").withColumn("broken", (F.col("min_txid") > F.col("prev_max") + 1) | (F.col("max_txid") <= F.col("prev_max")))


def wholeness(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Of each file: pages, first_page, last_page and whether they run from 1 on without a gap. Aggregates only, no ordered window."""
    got = pages.groupBy(*keys).agg(F.count_distinct("pgno").alias("pages"), F.min("pgno").alias("first_page"), F.max("pgno").alias("last_page"))
    return got.withColumn("whole", (F.col("first_page") == 1) & (F.col("last_page") == F.col("pages")))


def outcomes(writes: DataFrame, keys: list[str], body: list[str]) -> DataFrame:
    """Of each key what conditional puts give: Created, AlreadyIdentical or Conflict.

    Like writes are counted first, map-side and by key and body, so a key with very many of them does not meet in one task.
    """
    alike = writes.groupBy(*keys, *body).count()
    got = alike.groupBy(*keys).agg(F.sum("count").alias("writes"), F.count("*").alias("versions"))
    return got.withColumn("outcome", F.when(F.col("writes") == 1, "Created").when(F.col("versions") == 1, "AlreadyIdentical").otherwise("Conflict"))
