"""Bounded memory, object stores, conditional writes and plans over large catalogs."""

import os
import random
import sqlite3
import tracemalloc
from contextlib import closing

import pytest
from pyarrow import fs as pafs
from pyspark.sql import functions as F

from palimpsest.errors import Equivocation, NoSnapshot, NotWal, PrevFrameMismatch, UnalignedOffset
from palimpsest.functions import checksums as cs
from palimpsest.operators import frames, retention, versions
from palimpsest.plans import restore
from palimpsest.sources import datasources, paths
from palimpsest.sources import formats as fmt
from palimpsest.sources.store import CONFLICT, CREATED, IDENTICAL, Store
from palimpsest.streaming.database import Database
from palimpsest.streaming.syncer import ReplicaReader, Syncer, restore_to_path

PAGE, PAGES = 4096, 8192


def page(i: int, seed: int = 0) -> bytes:
    return random.Random(i * 7 + seed).randbytes(PAGE)


def peak_mb(f) -> float:
    tracemalloc.start()
    f()
    top = tracemalloc.get_traced_memory()[1] / 2**20
    tracemalloc.stop()
    return top


def test_snapshot_merge_and_verification_hold_few_pages(tmp_path):
    """32 MB of pages that don't compress, well below that in memory."""
    store = Store(str(tmp_path))
    key = (9, 1, 1)

    def written(path, fill):
        up = paths.Upload(path)
        fill(up.write)
        up.publish()

    assert peak_mb(lambda: written(store.path(*key), lambda w: fmt.snapshot_to(w, page, PAGES, PAGE, 1, 0))) < 16
    change = fmt.write_ltx(fmt.LtxHeader(fmt.NO_CHECKSUM, PAGE, PAGES, 2, 2, 0), ((i, page(i, 1)) for i in range(1, PAGES, 100)))
    store.put(0, 2, 2, change)
    files = [(store.ranged(*k), store.size(*k)) for k in (key, (0, 2, 2))]
    assert peak_mb(lambda: written(store.path(9, 1, 2), lambda w: fmt.merge_to(w, files))) < 16
    assert peak_mb(lambda: restore_to_path(store, str(tmp_path / "back"))) < 16
    with open(tmp_path / "back", "rb") as f:
        for i in range(1, PAGES + 1):
            assert f.read(PAGE) == page(i, 1 if i % 100 == 1 else 0)


def test_syncing_a_large_transaction_holds_few_pages(tmp_path):
    db, store = Database(str(tmp_path / "a.db")), Store(str(tmp_path / "r"))
    s = Syncer(db, store)
    with closing(sqlite3.connect(db.path, isolation_level=None)) as app:
        app.execute("CREATE TABLE b (x BLOB)")
        app.execute("INSERT INTO b SELECT randomblob(4000) FROM (WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 6000) SELECT i FROM n)")
        assert peak_mb(s.sync) < 24
        app.execute("UPDATE b SET x = randomblob(3999)")
        assert peak_mb(s.sync) < 24 and peak_mb(s.snapshot) < 24
        image = app.execute("SELECT count(*), sum(length(x)) FROM b").fetchone()
    reader = ReplicaReader(store)
    assert reader.txid == 2
    restore_to_path(store, str(tmp_path / "back.db"))
    with closing(sqlite3.connect(tmp_path / "back.db")) as back:
        assert back.execute("SELECT count(*), sum(length(x)) FROM b").fetchone() == image and back.execute("PRAGMA integrity_check").fetchone() == ("ok",)
    s.close()


@pytest.fixture(params=["local", "address", "object store"])
def store(request, tmp_path, monkeypatch):
    if request.param == "local":
        return Store(str(tmp_path))
    if request.param == "address":
        return Store(f"file://{tmp_path}")
    there, plain = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem()), paths.resolve
    monkeypatch.setattr(paths, "resolve", lambda p: (there, p.removeprefix("obj://")) if p.startswith("obj://") else plain(p))
    return Store("obj://bucket/replica")


def test_store_on_every_kind_of_path(store, tmp_path):
    key = (1, 2, 3)
    assert store.list(1) == [] and store.put_if_absent(*key, b"alpha") == CREATED
    assert store.put_if_absent(*key, iter([b"al", b"pha"])) == IDENTICAL and store.put_if_absent(*key, b"beta") == CONFLICT and store.get(*key) == b"alpha"
    store.put_parts(*key, [b"be", b"ta"])
    assert store.get(*key) == b"beta" and store.size(*key) == 4 and store.ranged(*key)(1, 2) == b"et"

    def broken():
        yield b"x"
        raise RuntimeError

    for put in (store.put_parts, store.put_if_absent):
        with pytest.raises(RuntimeError):
            put(*key, broken())
    with pytest.raises(Equivocation):
        store.ship(*key, b"other")
    assert store.get(*key) == b"beta" and [(f.level, f.min_txid, f.max_txid, f.size) for f in store.list_all()] == [(1, 2, 3, 4)]
    assert not [n for _, _, names in os.walk(tmp_path) for n in names if not n.endswith(".ltx")]  # nothing is left over
    store.delete(*key)
    store.delete(*key)
    assert store.list_all() == []


def test_the_sink_refuses_other_bytes_of_one_transaction(spark, tmp_path):
    datasources.register(spark)

    def write(text, mode="append"):
        rows = spark.createDataFrame([(3, bytearray(text.ljust(512))), (1, bytearray(text.ljust(512)))], "pgno long, data binary").coalesce(1)
        rows.write.format("ltx").options(path=str(tmp_path), page_size=512, commit=9, min_txid=2, max_txid=2).mode(mode).save()

    write(b"a")
    write(b"a")
    with pytest.raises(Exception, match="Equivocation"):
        write(b"b")
    got = spark.read.format("ltx").option("path", str(tmp_path)).option("verify", "true").load().orderBy("pgno").collect()
    assert [(r["pgno"], bytes(r["data"]).strip()) for r in got] == [(1, b"a"), (3, b"a")]
    write(b"b", "overwrite")
    assert {bytes(r["data"]).strip() for r in spark.read.format("ltx").option("path", str(tmp_path)).load().collect()} == {b"b"}
    assert [n for _, _, names in os.walk(tmp_path) for n in names] == [f"{2:016x}-{2:016x}.ltx"]


def test_a_database_that_stays_out_of_wal_mode_is_refused():
    with pytest.raises(NotWal):
        Database(":memory:")


def test_tail_of_a_wal(tmp_path):
    rows = [(k % 5 + 1, 5 if k % 3 == 2 else 0, bytes([k]) * 512) for k in range(10)]
    data = bytearray(fmt.write_wal(rows, 512, (7, 8)))
    path = tmp_path / "wal"
    path.write_bytes(data)
    h, step = fmt.wal_header(bytes(data)), 536
    with open(path, "rb") as f:
        offsets, size, end = fmt.committed_offsets(h, f)
        whole, size_, end_ = fmt.page_map(h, fmt.wal_frames(h, bytes(data[32:])))
        assert (offsets, size, end) == ({k: x.offset for k, x in whole.items()}, size_, end_) and end == 32 + 9 * step
        assert fmt.committed_offsets(h, f, 32 + 3 * step)[0] == {k: 32 + i * step for k, i in ((1, 5), (2, 6), (3, 7), (4, 8), (5, 4))}
        assert fmt.committed_offsets(h, f, end) == ({}, 0, 0)
        with pytest.raises(UnalignedOffset):
            fmt.seed_before(h, f, 33)
    data[32 + 2 * step + 8] ^= 1  # other salts
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(PrevFrameMismatch):
        fmt.seed_before(h, f, 32 + 3 * step)


def test_crc_lanes_agree():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 4095, 4096, 5000, 70_001, 1_000_003):
        data = rng.randbytes(n)
        plain = cs.ONES
        table = cs._table()
        for b in data[:5000]:
            plain = int(table[(plain ^ b) & 255]) ^ plain >> 8
        assert n > 5000 or cs.crc64(data) == plain ^ cs.ONES
        assert cs.crc64(data) == cs.combine(cs.crc64(data[: n // 3]), cs.crc64(data[n // 3 :]), n - n // 3)


def test_plans_of_large_catalogs_by_joins(spark):
    rng = random.Random(3)
    for _ in range(4):
        files, at = set(), 0
        while at < 60:
            n = rng.randint(1, 4)
            files.add((0, at + 1, at + n))
            at += n
        for level, width in ((1, 10), (2, 25)):
            files |= {(level, k + 1, k + width) for k in range(0, 60 - width, width)}
        files = [f for f in files if rng.random() < 0.9 or f[1] == 1]
        df = spark.createDataFrame(files, "level int, min_txid long, max_txid long")
        small, large = (sorted(map(tuple, restore.plan_frame(df, collect=c).collect())) for c in (1000, 3))
        assert small == large == [(i + 1, *s) for i, s in enumerate(restore.plan(files))]
    with pytest.raises(NoSnapshot):
        restore.plan_frame(spark.createDataFrame([(0, 2, 3), (0, 4, 5)], "level int, min_txid long, max_txid long"), collect=1)


def test_committed_prefix_ends_before_the_first_bad_frame(spark):
    rows = [(i, i % 4 + 1, 4 if i % 3 == 2 else 0, i != 7, f"v{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "frame_no long, pgno long, commit long, ok boolean, data string")
    assert sorted(r["frame_no"] for r in frames.committed(df).collect()) == list(range(6))
    assert sorted(r["frame_no"] for r in frames.committed(df, ok=F.lit(True)).collect()) == list(range(12))
    assert frames.committed(df.where("commit = 0")).count() == 0 == frames.page_map(df.where("frame_no > 100")).count()
    assert {(r["pgno"], r["data"]) for r in frames.page_map(df).collect()} == {(1, "v4"), (2, "v5"), (3, "v2"), (4, "v3")}


def test_newest_first_and_outcomes(spark):
    steps = [spark.createDataFrame(x, "k long, v string") for x in ([(1, "a")], [(1, "b"), (2, "b")], [(2, "c"), (3, "c")])]
    assert sorted(map(tuple, versions.newest_first(steps, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    writes = spark.createDataFrame([(1, "x")] + [(2, "x")] * 2 + [(3, "x"), (3, "y"), (3, "y")], "k long, body string")
    assert sorted(map(tuple, frames.outcomes(writes, ["k"], ["body"]).collect())) == [(1, 1, 1, "Created"), (2, 2, 1, "AlreadyIdentical"), (3, 3, 2, "Conflict")]


def test_level_0_keeps_what_it_must(spark):
    """Cases of the retention rules, and unknown ages."""
    files = [(0, i, i, 100 + 10 * i) for i in range(4)]

    def gone(rows, cutoff, top):
        df = spark.createDataFrame(rows, "level int, min_txid long, max_txid long, created_at long")
        return sorted(r["max_txid"] for r in retention.level0(df, F.lit(cutoff), top).collect())

    assert gone(files, 10_000, 0) == [0] and gone(files, 10_000, 1) == [0, 1] and gone(files, 115, 3) == [0, 1] and gone(files, 10_000, 3) == [0, 1, 2]
    assert gone([(0, 1, 1, None), (0, 2, 2, 100), (0, 3, 3, 500)], 200, 3) == [1, 2] and gone([], 5, 5) == []


