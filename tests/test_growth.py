"""Queries over other tables than the driver's: larger ones, and such as leave nothing to find."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest import staging
from palimpsest.functions import checksums as cs
from palimpsest.plans import queries, stored
from palimpsest.sources import formats as fmt
from palimpsest.sources import paths

SMALL = "/root/testdata/sf0.001"


def copies(spark, tmp_path, n):
    """Events ``n`` times with shifted ids, at the same times: every day's file then ends in the last copy."""
    e = spark.read.parquet(f"{SMALL}/events.parquet")
    many = e.crossJoin(spark.range(n).withColumnRenamed("id", "copy")).withColumn("event_id", F.col("event_id") + 1000 * F.col("copy")).drop("copy")
    many.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def agrees(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = [tuple(r) for r in queries.QUERIES[name](spark, folder).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


@pytest.mark.parametrize("name", ["plan_restore", "plan_restore_gap", "plan_restore_txid", "plan_restore_time"])
def test_plans_without_a_first_file_have_no_steps(spark, tmp_path, name):
    assert (agrees(spark, copies(spark, tmp_path / "many", 6), name) == []) == (name == "plan_restore_txid")
    spark.read.parquet(f"{SMALL}/events.parquet").where("false").write.parquet(f"{tmp_path}/none/events.parquet")
    assert agrees(spark, str(tmp_path / "none"), name) == []


def test_running_checksums_of_rows_together():
    rng = np.random.default_rng(5)
    for n, length, big in ((1, 8, False), (5, 24, True), (1000, 520, False), (1025, 64, True)):
        rows, seed, want = rng.integers(0, 256, (n, length), np.uint8), (2**32 - 1, 7), []
        for r in rows:
            want.append(cs.wal_checksum_of(r.tobytes(), want[-1] if want else seed, big))
        assert list(zip(*(x.tolist() for x in cs.wal_chain(rows, seed, big)), strict=True)) == want
        ends = tuple(int(x[-1]) for x in cs.wal_chain(rows, (0, 0), big))
        assert cs.wal_carry(ends, seed, n, length) == want[-1]


def test_a_planted_wal_is_made_in_parts_and_never_held(spark, tmp_path, monkeypatch):
    """The same bytes as one writer's, from ten parts; this process holds a small part of the file."""
    monkeypatch.setattr(stored, "FRAMES_A_PART", 600)
    folder = copies(spark, tmp_path, 6)
    monkeypatch.setattr(paths, "PART", 1 << 16)
    tracemalloc.start()
    path = stored._wal(spark, folder, broken=True)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    e = spark.read.parquet(f"{folder}/events.parquet").orderBy("event_id").collect()
    rows = ((r["user_id"] + 1, 40 + r["event_id"] % 100 if r["event_type"] == "purchase" else 0, str(r["event_id"]).encode().ljust(512)) for r in e)
    want = bytearray(fmt.write_wal(rows, 512, (6000, 3000)))
    want[32 + 3000 * 536 + 535] ^= 1
    with paths.open_read(path) as f:
        assert f.read() == want
    assert top < len(want) / 3
    assert [x for x, _, _ in paths.listing(path.rpartition("/")[0], deep=True)] == [paths.resolve(path)[1]]


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if q.startswith("replica_")))
def test_a_replicated_database_is_filled_and_read_by_its_task(spark, monkeypatch, name):
    """No event and no page passes through the driver, and the store is gone once the result is there."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view events as select * from '{SMALL}/events.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    columns = [d[0] for d in con.description]

    def refused(*_, **__):
        raise AssertionError("through the driver")

    left = set(staging._written)
    with monkeypatch.context() as m:
        for owner, way in ((type(spark), "createDataFrame"), (type(spark.range(0)), "toLocalIterator")):
            m.setattr(owner, way, refused)
        got = queries.QUERIES[name](spark, SMALL)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    assert set(staging._written) - left == {got._palimpsest_path}


def test_shares_of_rows_by_id():
    batches = [pa.RecordBatch.from_pydict({"i": list(range(lo, hi)), "x": [0.5] * (hi - lo)}) for lo, hi in ((0, 3), (3, 3), (3, 9), (20, 22))]
    shares = [[r[0] for r in share] for share in stored._shares(iter(batches), [2, 3, 8, 15, 25])]
    assert shares == [[0, 1], [2], [3, 4, 5, 6, 7], [8], [20, 21]]
    assert [b.num_rows for b in stored._batches(iter([]), "a long")] == []


@pytest.mark.parametrize("name", sorted(q for q in queries.QUERIES if q.startswith("wal_") and q != "wal_checksums"))
def test_queries_over_a_wal_of_many_parts(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(stored, "FRAMES_A_PART", 300)
    monkeypatch.setattr(fmt, "write_wal", None)  # holds the file
    assert agrees(spark, copies(spark, tmp_path, 2), name)
