"""Structured Streaming from a WAL to a store: each micro-batch becomes one change file, exactly once by transaction number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import page_map
from ..sources import formats as fmt
from ..sources.datasources import register


def ship_wal(spark: SparkSession, wal: str, replica: str, checkpoint: str, timestamp_ms: int = 0, first_txid: int = 1) -> StreamingQuery:
    """Starts a query over all that is committed now. A batch that is run again writes the same bytes, which the store accepts.

    The first file holds what the WAL has; ship a snapshot first if pages were checkpointed before.
    """
    register(spark)
    def batch(df: DataFrame, n: int) -> None:
        last = df.where("commit <> 0").agg(F.max_by("commit", "frame_no"), F.max("page_size")).first()
        if last[0] is None:
            return
        commit, size = last
        pages = page_map(df).where(F.col("pgno") != fmt.lock_page(size)).coalesce(1)
        txid = first_txid + n
        how = {"path": replica, "level": 0, "page_size": size, "commit": commit, "min_txid": txid, "max_txid": txid, "timestamp": timestamp_ms}
        pages.select("pgno", "data").write.format("ltx").options(**how).mode("append").save()  # one task writes it, to the store's conditions

    stream = spark.readStream.format("wal").option("path", wal).load()
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
