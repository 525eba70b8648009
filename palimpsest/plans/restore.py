"""Restore planning: the chain of files that reaches furthest at every step, so with the fewest files.

The catalog has a row a file. ``plan`` runs in the driver; ``plan_frame`` is the same for DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import NoSnapshot, TxidTooOld
from ..staging import cut

Step = tuple[int, int, int]


def plan(files: Iterable[Step]) -> list[Step]:
    """(level, min, max) steps from transaction 1 on; a gap ends the chain. Of equal reach the higher level, then the later start."""
    files = sorted(files, key=lambda f: f[1])
    out: list[Step] = []
    at, i, best = 0, 0, None
    while True:
        while i < len(files) and files[i][1] <= at + 1:
            key = (files[i][2], files[i][0], files[i][1])
            best = key if best is None or key > best else best
            i += 1
        if best is None or best[0] <= at:
            break
        out.append((best[1], best[2], best[0]))
        at = best[0]
    if not out:
        raise NoSnapshot("no file starts at transaction 1")
    return out


def plan_to(files: Iterable[Step], txid: int) -> list[Step]:
    try:
        return plan(f for f in files if f[2] <= txid)
    except NoSnapshot as e:
        raise TxidTooOld(str(txid)) from e


#: Files of a catalog that the driver plans by itself; beyond it the plan is made by joins.
COLLECT = 200_000


def plan_frame(catalog: DataFrame, collect: int = COLLECT, or_none: bool = False) -> DataFrame:
    """(step, level, min_txid, max_txid), by ``plan`` for catalogs of up to ``collect`` files and by ``followed`` for larger ones.

    A catalog where no file starts at transaction 1 is an error, or with ``or_none`` a plan without steps.
    """
    spark = catalog.sparkSession
    rows = catalog.select("level", "min_txid", "max_txid").limit(collect + 1).collect()
    try:
        if len(rows) > collect:
            return followed(hops(catalog))
        steps = [(i + 1, *s) for i, s in enumerate(plan((r["level"], r["min_txid"], r["max_txid"]) for r in rows))]
    except NoSnapshot:
        if not or_none:
            raise
        steps = []
    return spark.createDataFrame(steps, "step int, level int, min_txid long, max_txid long")


def followed(hops: DataFrame) -> DataFrame:
    """The chain from position 0, by jumps that double: after round k all steps up to 2 ** k are there. Rounds are logarithmic."""
    hops = cut(hops, "hops")
    jump = cut(hops.select("pos", F.col("max_txid").alias("to")), "jumps")
    got = cut(hops.where("pos = 0").select(F.lit(1).alias("step"), "level", "min_txid", "max_txid"), "chain")
    if got.isEmpty():
        raise NoSnapshot("no file starts at transaction 1")
    reach = 1
    while True:
        # everything reached so far, moved on by as many steps as there are
        on = got.join(jump, F.col("max_txid") == F.col("pos")).select((F.col("step") + reach).alias("step"), F.col("to").alias("end_"))
        ends = on.join(hops.select("level", "min_txid", "max_txid"), F.col("end_") == F.col("max_txid"))
        best = ends.groupBy("step").agg(F.max(F.struct("max_txid", "level", "min_txid")).alias("f")).select("step", "f.level", "f.min_txid", "f.max_txid")
        new = cut(best, "chain")
        if new.isEmpty():
            return got
        got = cut(got.unionByName(new), "chain")
        then = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.pos")).select("a.pos", "b.to")
        jump, reach = cut(then, "jumps"), reach * 2


def hops(catalog: DataFrame) -> DataFrame:
    """(pos, level, min_txid, max_txid): from 0 and each file's end, the file that reaches furthest among those that start by then.

    Files and positions are sorted by start together and the best file so far is carried along, so no pair is ever formed. The
    window runs over catalog rows in one task; none reads the pages.
    """
    best = F.struct("max_txid", "level", "min_txid")
    files = catalog.select(F.col("min_txid").alias("at_"), F.lit(0).alias("kind_"), F.lit(None).cast("long").alias("pos"), best.alias("file_"))
    ends = catalog.select(F.col("max_txid").alias("pos")).union(catalog.sparkSession.range(1).select("id")).distinct()
    marks = ends.select((F.col("pos") + 1).alias("at_"), F.lit(1).alias("kind_"), "pos", F.lit(None).cast(files.schema["file_"].dataType).alias("file_"))
    so_far = Window.partitionBy(F.lit(0)).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = files.unionByName(marks).withColumn("file_", F.max("file_").over(so_far)).where("kind_ = 1 and file_.max_txid > pos")
    return got.select("pos", "file_.level", "file_.min_txid", "file_.max_txid")


def as_of(headers: DataFrame, timestamp_ms: int) -> int:
    """Greatest transaction of files written at ``timestamp_ms`` or before."""
    got = headers.where(F.col("timestamp") <= timestamp_ms).agg(F.max("max_txid")).first()[0]
    if got is None:
        raise TxidTooOld(str(timestamp_ms))
    return got
