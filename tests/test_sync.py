import sqlite3
from datetime import UTC, datetime

import pytest

from palimpsest.errors import Equivocation, InvalidLevels, Locked, NoSnapshot, TxidTooOld
from palimpsest.operators.tiers import Levels
from palimpsest.plans.restore import plan, plan_to
from palimpsest.sources.store import CONFLICT, CREATED, IDENTICAL, Store
from palimpsest.streaming.database import Database
from palimpsest.streaming.syncer import Config, Driver, ReplicaReader, Syncer, restore, restore_to_path, restore_to_timestamp


class World:
    def __init__(self, tmp):
        self.path, self.tmp = str(tmp / "a.db"), tmp
        self.app = sqlite3.connect(self.path, isolation_level=None)
        self.store = Store(str(tmp / "replica"))
        self.sync = Syncer(Database(self.path), self.store)
        self.app.execute("create table items(id integer primary key, name text)")

    def rows(self, lo, n):
        self.app.execute("begin")
        self.app.executemany("insert into items values(?,?)", [(i, f"item-{i:04d}" * 20) for i in range(lo, lo + n)])
        self.app.execute("commit")

    def count(self, image):
        p = self.tmp / "restored.db"
        p.write_bytes(image)
        c = sqlite3.connect(p)
        assert c.execute("pragma integrity_check").fetchone() == ("ok",)
        n = c.execute("select count(*) from items").fetchone()[0]
        c.close()
        return n


@pytest.fixture
def world(tmp_path):
    w = World(tmp_path)
    yield w
    w.sync.close()
    w.app.close()


def test_point_in_time(world):
    for k in range(4):
        world.rows(k * 10, 10)
        assert world.sync.sync()
    assert world.sync.sync() == 0
    assert [world.count(restore(world.store, t)[0]) for t in (1, 2, 3, 4, 99)] == [10, 20, 30, 40, 40]
    image, top = restore_to_timestamp(world.store, 2**60)
    assert top == 4 and world.count(image) == 40
    with pytest.raises(TxidTooOld):
        restore_to_timestamp(world.store, 0)
    out = str(world.tmp / "o.db")
    assert restore_to_path(world.store, out) == 4 and open(out, "rb").read() == image
    reader = ReplicaReader(world.store)
    assert b"".join(reader.read_page(i) for i in range(1, reader.commit + 1)) == image
    assert reader.read_page(reader.commit + 1) is None


def test_compact_and_cascade(world):
    for k in range(5):
        world.rows(k * 20, 20)
        world.sync.sync()
    assert [(i.min_txid, i.max_txid) for i in (world.sync.compact_level(1), world.sync.compact_level(2))] == [(1, 5), (1, 5)]
    s = world.sync.snapshot()
    assert (s.min_txid, s.max_txid) == (1, 5) and world.sync.snapshot() is None
    assert world.count(restore(world.store)[0]) == 100
    far = datetime.now(UTC).timestamp() + 10_000
    assert world.sync.enforce_l0_retention(far) == 4 and len(world.store.list(0)) == 1
    assert world.sync.enforce_snapshot_retention(far) == 0 and len(world.store.list(9)) == 1


def test_legacy_compact_keeps_the_newest(world):
    for k in range(5):
        world.rows(k * 20, 20)
        world.sync.sync()
    i = world.sync.compact()
    assert (i.min_txid, i.max_txid) == (1, 4)
    assert len(world.store.list(0)) == 1 and len(world.store.list(9)) == 1 and world.count(restore(world.store)[0]) == 100
    with pytest.raises(TxidTooOld):
        restore(world.store, 2)


def test_checkpoint_and_new_generation(world):
    world.rows(0, 50)
    world.sync.checkpoint_now("TRUNCATE")
    world.rows(50, 50)
    world.sync.flush()
    assert world.count(restore(world.store)[0]) == 100


def test_changes_while_stopped_call_for_a_full_file(world):
    world.rows(0, 30)
    world.sync.flush()
    world.sync.close()
    world.rows(30, 30)
    world.app.execute("pragma wal_checkpoint(truncate)")
    world.rows(60, 10)
    world.sync = Syncer(Database(world.path), world.store)
    world.sync.flush()
    assert world.count(restore(world.store)[0]) == 70


def test_failed_upload_is_repeated(world):
    world.rows(0, 10)
    ship, world.store.ship = world.store.ship, lambda *a: (_ for _ in ()).throw(OSError("down"))
    with pytest.raises(OSError):
        world.sync.sync()
    world.store.ship = ship
    assert world.sync.staged_backlog_bytes() > 0
    world.rows(10, 10)
    assert world.sync.flush() == 2 and world.count(restore(world.store)[0]) == 20


def test_lock(world):
    with pytest.raises(Locked):
        Syncer(Database(world.path), world.store)


def test_driver_tick(world):
    d = Driver(world.sync, Config(snapshot_seconds=3600))
    world.rows(0, 10)
    first = d.tick(1_000_000.0)
    assert first.pages and [x for x, _ in first.compactions] == [1, 2, 3] and first.snapshot
    assert not d.tick(1_000_001.0).compactions


def test_store(tmp_path):
    s = Store(str(tmp_path))
    assert [s.put_if_absent(0, 1, 1, x) for x in (b"alpha", b"alpha", b"beta")] == [CREATED, IDENTICAL, CONFLICT]
    assert s.get(0, 1, 1) == b"alpha"
    with pytest.raises(Equivocation):
        s.ship(0, 1, 1, b"beta")
    s.put(0, 2, 2, b"x")
    assert [(f.min_txid, f.size) for f in s.list_all()] == [(1, 5), (2, 1)]
    s.delete(0, 1, 1)
    assert len(s.list(0)) == 1


def test_plan():
    files = [(0, i, i) for i in range(1, 8)] + [(1, 1, 3), (1, 4, 6), (9, 1, 2)]
    assert plan(files) == [(1, 1, 3), (1, 4, 6), (0, 7, 7)]
    assert plan([f for f in files if f != (0, 7, 7)] + [(0, 9, 9)]) == [(1, 1, 3), (1, 4, 6)]
    assert plan([(0, 1, 2), (1, 1, 2)]) == [(1, 1, 2)]
    with pytest.raises(NoSnapshot):
        plan([(0, 2, 3)])
    with pytest.raises(TxidTooOld):
        plan_to([(9, 1, 5)], 4)


def test_levels():
    v = Levels()
    assert (v.prev_boundary(1, 95), v.next_boundary(1, 95), v.prev_boundary(1, 120), v.next_boundary(1, 120)) == (90, 120, 120, 150)
    assert (v.prev_level(9), v.next_level(3), v.prev_level(0), v.next_level(9), v.max_level) == (3, 9, None, None, 3)
    for bad in ([(1, 30), (0, 0)], [(0, 5)], [(0, 0), (1, 0)], []):
        with pytest.raises(InvalidLevels):
            Levels.of(bad)
