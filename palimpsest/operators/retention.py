"""Retention rules over the file catalog (level, min_txid, max_txid, created_at), as DataFrames of files to delete.

The newest file of a level is always kept. Unknown age keeps a snapshot but doesn't stop a scan of level 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_KEY = ["min_txid", "max_txid"]


def but_newest(files: DataFrame) -> DataFrame:
    """All files but the newest of each level; one aggregate of a row a level, and a broadcast of these."""
    newest = files.groupBy(F.col("level").alias("level_")).agg(F.max(F.struct(*_KEY)).alias("newest_"))
    return files.join(F.broadcast(newest), F.col("level").eqNullSafe(F.col("level_")) & (F.struct(*_KEY) < F.col("newest_"))).select(*files.columns)


def snapshots(files: DataFrame, cutoff: Column) -> DataFrame:
    """Files created before ``cutoff`` but the newest of each level."""
    return but_newest(files).where(F.col("created_at") < cutoff)


def min_retained(files: DataFrame, cutoff: Column) -> DataFrame:
    """One row: the least max_txid among files that haven't expired, 0 if all have; a file kept only as the newest doesn't count."""
    return files.agg(F.coalesce(F.min(F.when(F.coalesce(F.col("created_at") >= cutoff, F.lit(True)), F.col("max_txid"))), F.lit(0)).alias("min_retained"))


def below(files: DataFrame, txid: int) -> DataFrame:
    return but_newest(files).where(F.col("max_txid") < txid)


def level0(files: DataFrame, cutoff: Column, max_level1: int | None = None) -> DataFrame:
    """Level-0 files that level 1 holds already, up to the first that is newer than ``cutoff``; the newest only goes if such a stop was met before it.

    ``max_level1`` defaults to the catalog's. One aggregate of one row says where to stop; no ordered window.
    """
    zero, key = F.col("level") == 0, F.struct(*_KEY)
    top = F.max(F.when(F.col("level") == 1, F.col("max_txid"))) if max_level1 is None else F.lit(max_level1)
    stop = F.min(F.when(zero & (F.col("created_at") > cutoff), key))
    marks = files.agg(F.coalesce(top, F.lit(0)).alias("top_"), stop.alias("stop_"), F.max(F.when(zero, key)).alias("newest_"))
    gone = F.when(F.col("stop_").isNull(), key < F.col("newest_")).otherwise(key < F.col("stop_"))
    return files.where(zero).join(F.broadcast(marks), (F.col("max_txid") <= F.col("top_")) & gone).select(*files.columns)


def without(files: DataFrame, deleted: DataFrame) -> DataFrame:
    key = ["level", "min_txid", "max_txid"]
    return files.join(deleted.select(*key), key, "left_anti")
