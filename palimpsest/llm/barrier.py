"""Keeps the optimizer from copying long expressions into filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, evaluated above df's projections. A filter that moves below them repeats their expressions once for each use, and nested ones so many times more."""
    return df.withColumn("held_", F.monotonically_increasing_id()).where(condition & (F.col("held_") >= 0)).drop("held_")
