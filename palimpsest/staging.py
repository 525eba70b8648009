"""Intermediate tables in the folder that driver and executors share.

``cut`` writes a DataFrame once and reads it back, which ends its lineage at files that outlive any executor.
(``DataFrame.checkpoint`` would compute an unpersisted plan twice.)
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}
#: Folders that ``cut`` or others wrote and nothing has deleted yet.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a single-process session gets a temporary folder; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if os.getpid() not in _own:
        base = "/tmp/checkpoints"
        os.makedirs(base, exist_ok=True)
        path = tempfile.mkdtemp(prefix="palimpsest-", dir=base)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[os.getpid()] = path
    return f"file://{_own[os.getpid()]}"


def placed(path: str) -> str:
    """``path``, a folder that something else than ``cut`` fills; deleted when the process ends."""
    _written.append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema. What is left when the process ends is deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)  # rows of text take half the disk of the default
    back = spark.read.schema(df.schema).parquet(path)
    back._palimpsest_path = path
    return back


def drop(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_palimpsest_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hpath, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes all that ``cut`` writes within, but for the DataFrames given to what it yields (which returns them)."""
    before, kept = set(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_palimpsest_path", None))
        return df

    yield keep
    for path in [p for p in _written if p not in before and p not in kept]:
        _delete(spark, path)


def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        try:
            if spark is not None:
                _delete(spark, path)
            elif path.startswith("file:"):
                shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        except Exception:  # noqa: BLE001  the JVM may be gone before this process
            spark = None


atexit.register(_sweep)
