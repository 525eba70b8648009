import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import checksums as cs
from palimpsest.functions import columns as C
from palimpsest.operators import frames, retention, versions
from palimpsest.plans import queries
from palimpsest.plans import stored  # noqa: F401  adds its queries
from palimpsest.sources import datasources, formats as fmt
from palimpsest.sources.store import Store
from palimpsest.streaming.ship import ship_wal
from palimpsest.streaming.syncer import restore

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).fetchdf()
    got = queries.QUERIES[name](spark, folder).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda d: sorted(map(tuple, d[cols].astype(str).to_numpy()))
    assert text(got) == text(want)


def database(path):
    c = sqlite3.connect(path, isolation_level=None)
    c.execute("pragma journal_mode=wal")
    c.execute("pragma wal_autocheckpoint=0")
    c.execute("create table t(id integer primary key, v text)")
    for lo in (0, 100):
        c.execute("begin")
        c.executemany("insert into t values(?,?)", [(i, "v" * 200) for i in range(lo, lo + 100)])
        c.execute("commit")
    return c


def test_sources_sink_and_stream(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "d.db")
    c = database(path)
    wal = spark.read.format("wal").option("path", path + "-wal").load()
    data = open(path + "-wal", "rb").read()
    h = fmt.wal_header(data)
    pages, commit, _ = fmt.page_map(h, fmt.wal_frames_from(data, 32))
    got = {r["pgno"]: bytes(r["data"]) for r in frames.page_map(wal).collect()}
    assert got == {k: f.data for k, f in pages.items()}
    replica = str(tmp_path / "replica")
    for _ in range(2):  # a query that starts again ships nothing new
        ship_wal(spark, path + "-wal", replica, str(tmp_path / "ckpt")).awaitTermination()
    assert [f.max_txid for f in Store(replica).list(0)] == [1]
    c.execute("insert into t values(1000, 'new')")
    ship_wal(spark, path + "-wal", replica, str(tmp_path / "ckpt")).awaitTermination()
    assert [f.max_txid for f in Store(replica).list(0)] == [1, 2]
    image, _ = restore(Store(replica))
    c.execute("pragma wal_checkpoint(truncate)")
    assert image == open(path, "rb").read()
    heads = spark.read.format("ltx_headers").option("path", replica).load().orderBy("min_txid").collect()
    assert [r["min_txid"] for r in heads] == [1, 2] and all(r["file_checksum"] < 0 for r in heads)
    ltx = spark.read.format("ltx").option("path", replica).option("verify", "true").load()
    newest = versions.latest(ltx.select("pgno", "max_txid", "data"), ["pgno"], "max_txid")
    assert {r["pgno"]: bytes(r["data"]) for r in newest.collect()} == {i + 1: image[i * 4096 : (i + 1) * 4096] for i in range(len(image) // 4096)}
    # a filter that was pushed stays with the loaded source, so a point lookup loads its own
    assert spark.read.format("ltx").option("path", replica).load().where("pgno = 2").count() >= 1
    base = spark.read.format("sqlite_pages").option("path", path).load()
    assert base.count() == len(image) // 4096
    newest.select("pgno", "data").repartition(1).sortWithinPartitions("pgno").write.format("ltx").options(path=replica, level="9", page_size="4096", commit=str(len(image) // 4096), min_txid="1", max_txid="2").mode("append").save()
    assert fmt.image(fmt.read_ltx(Store(replica).get(9, 1, 2)).pages, 4096, len(image) // 4096) == image
    c.close()


def files(spark, rows):
    return spark.createDataFrame(rows, "level int, min_txid long, max_txid long, created_at timestamp")


def at(s):
    return datetime.fromtimestamp(s)


def cut(s):
    return F.timestamp_seconds(F.lit(s))


def test_retention_vectors(spark):
    nine = files(spark, [(9, 1, 10, at(100)), (9, 1, 20, at(200)), (9, 1, 30, at(300))])
    ids = lambda df: sorted(r["max_txid"] for r in df.collect())
    assert ids(retention.snapshots(nine, cut(250))) == [10, 20] and retention.min_retained(nine, cut(250)).first()[0] == 30
    assert ids(retention.snapshots(nine, cut(10000))) == [10, 20] and retention.min_retained(nine, cut(10000)).first()[0] == 0
    zero = [(0, i, i, at(90 + 10 * i)) for i in range(1, 5)]
    with1 = lambda top: files(spark, zero + ([(1, 1, top, at(1))] if top else []))
    assert ids(retention.level0(with1(0), cut(10000))) == []
    assert ids(retention.level0(with1(2), cut(10000))) == [1, 2]
    assert ids(retention.level0(with1(4), cut(115))) == [1, 2]
    assert ids(retention.level0(with1(4), cut(10000))) == [1, 2, 3]
    assert ids(retention.level0(with1(4), cut(110))) == [1, 2]  # equality doesn't stop
    old = files(spark, [(0, 1, 5, None), (0, 6, 10, None), (0, 11, 15, None)])
    assert ids(retention.below(old, 12)) == [5, 10] == ids(retention.below(old, 999))
    assert ids(retention.snapshots(old, cut(10**6))) == []


def test_columns(spark):
    df = spark.createDataFrame([("9/0009/0000000000000001-00000000000000ff.ltx", "1700000000000"), ("x", "2023-11-14T22:13:20Z"), ("x", "no")], "p string, t string")
    level, lo, hi = C.parse_file_name(F.col("p"))
    assert [tuple(r) for r in df.select(level, lo, hi, C.timestamp_ms(F.col("t"))).collect()] == [(9, 1, 255, 1700000000000), (None, None, None, 1700000000000), (None, None, None, None)]
    assert spark.range(1).select(C.hex16(F.lit(cs.signed(cs.FLAG | 5)))).first()[0] == "8000000000000005"
    assert [r[0] for r in spark.range(510, 515).where(C.is_page_size(F.col("id"))).collect()] == [512]


def test_whole_queries_reach_the_last_event(spark):
    folder = "/root/testdata/sf0.1"
    last = spark.read.parquet(f"{folder}/events.parquet").agg({"event_id": "max"}).first()[0]
    assert queries.QUERIES["newest_first"](spark, folder).agg({"event_id": "max"}).first()[0] == last
    files = queries.QUERIES["ltx_files"](spark, folder).selectExpr("max(cast(data as bigint))", "min(min_txid)", "max(max_txid)").first()
    assert tuple(files) == (last, 1, last + 1)
