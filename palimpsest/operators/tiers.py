"""Compaction levels: dense from 0, the first without an interval, snapshots on level 9."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidLevels
from .versions import latest

SNAPSHOT_LEVEL = 9


@dataclass(frozen=True)
class Levels:
    """Seconds of each level's window, level 0 first."""

    intervals: tuple[int, ...] = (0, 30, 300, 3600)

    def __post_init__(self) -> None:
        if not self.intervals:
            raise InvalidLevels("no levels")
        if self.intervals[0]:
            raise InvalidLevels("level 0 has no interval")
        if any(x <= 0 for x in self.intervals[1:]):
            raise InvalidLevels("every level above 0 needs an interval")
        if len(self.intervals) > SNAPSHOT_LEVEL:
            raise InvalidLevels("too many levels")

    @classmethod
    def of(cls, pairs: list[tuple[int, int]]) -> Levels:
        if [k for k, _ in pairs] != list(range(len(pairs))):
            raise InvalidLevels("levels must be dense and in order")
        return cls(tuple(v for _, v in pairs))

    @property
    def max_level(self) -> int:
        return len(self.intervals) - 1

    def is_valid(self, level: int) -> bool:
        return 0 <= level <= self.max_level or level == SNAPSHOT_LEVEL

    def prev_level(self, level: int) -> int | None:
        return self.max_level if level == SNAPSHOT_LEVEL else level - 1 if 0 < level <= self.max_level else None

    def next_level(self, level: int) -> int | None:
        return level + 1 if 0 <= level < self.max_level else SNAPSHOT_LEVEL if level == self.max_level else None

    def prev_boundary(self, level: int, now: float) -> float | None:
        return boundary(now, self.intervals[level]) if 0 <= level <= self.max_level else None

    def next_boundary(self, level: int, now: float) -> float | None:
        return boundary(now, self.intervals[level]) + self.intervals[level] if 0 <= level <= self.max_level else None


def boundary(now: float, seconds: int) -> float:
    return now if not seconds else max(0, now // seconds * seconds)


def frontier(files: DataFrame, source: int, target: int) -> DataFrame:
    """Source files that begin after all of the target level; one-row aggregate, so the comparison is a broadcast."""
    top = files.where(F.col("level") == target).agg(F.coalesce(F.max("max_txid"), F.lit(0)).alias("top_"))
    return files.where(F.col("level") == source).join(F.broadcast(top), F.col("min_txid") > F.col("top_")).drop("top_")


def reached(files: DataFrame, ts: Column) -> DataFrame:
    """One row: ``reached``, the greatest transaction of files written at ``ts`` or before; null if there is none."""
    return files.where(F.col("created_at") <= ts).agg(F.max("max_txid").alias("reached"))


def rolled_up(log: DataFrame, keys: list[str], unit: str, ts: str = "ts") -> DataFrame:
    """Last version of each key in each tumbling window of a unit that date_trunc knows."""
    kind = dict(log.dtypes)[ts]
    return latest(log.withColumn("win", F.date_trunc(unit, ts).cast(kind)), ["win", *keys])
