"""Queries over the driver's tables, with the SQL that must give the same rows.

``events`` serves as the change log: transaction = event_id + 1, page = user_id + 1, a purchase commits. The file catalog has a
file a day (level 0), a week (level 1) and one snapshot (level 9).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import frames, retention, tiers, versions
from ..sources import datasources
from ..staging import shared_dir
from ..tables import table
from . import restore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_CAT = """cat as (
 select 0 as level, min(event_id)+1 as min_txid, max(event_id)+1 as max_txid, max(ts) as created_at from events group by cast(ts as date)
 union all select 1, min(event_id)+1, max(event_id)+1, max(ts) from events where ts < timestamp '2024-01-22' group by floor((day(ts)-1)/7)
 union all select 9, 1, max(event_id)+1, max(ts) from events where ts < timestamp '2024-01-15')"""


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ntz(text: str):
    return F.to_timestamp_ntz(F.lit(text))


def log(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("txid"), "value", "ts", *extra)


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file. The log is read once and summed up by day; a day then counts for its file on each level."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    days = e.groupBy(F.to_date("ts").alias("d")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.max("ts").alias("at"))
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    week = F.floor((F.dayofmonth("d") - 1) / 7).cast("int")
    on = [F.struct(F.lit(0).alias("level"), day.alias("nth"))]
    on += [F.when(F.col("d") < F.lit(end).cast("date"), F.struct(F.lit(level).alias("level"), nth.alias("nth"))) for level, end, nth in ((1, "2024-01-22", week), (9, "2024-01-15", F.lit(0)))]
    each = days.select(F.explode(F.array_compact(F.array(*on))).alias("on"), "lo", "hi", "at")
    files = each.groupBy("on").agg(F.min("lo").alias("lo"), (F.max("hi") + 1).alias("max_txid"), F.max("at").alias("created_at"))
    low = F.when(F.col("on.level") == 9, F.lit(1).cast("long")).otherwise(F.col("lo") + 1)
    return files.select("on.level", low.alias("min_txid"), "max_txid", "created_at")


@query("""with lc as (select max(event_id) as last_commit, max_by(40 + event_id % 100, event_id) as commit_sz from events where event_type='purchase')
select user_id+1 as pgno, max(event_id) as frame_no, max_by(value,event_id) as data from events, lc where event_id <= last_commit and user_id+1 <= commit_sz group by user_id""")
def page_map(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("pgno"), F.col("event_id").alias("frame_no"), F.col("value").alias("data"), F.when(F.col("event_type") == "purchase", 40 + F.col("event_id") % 100).otherwise(0).alias("commit"))
    return frames.page_map(e, ok=F.lit(True))


@query("""with b as (select min(event_id) as bad from events where value > 400), lc as (select max(event_id) as m from events, b where event_type='purchase' and (bad is null or event_id < bad))
select event_id, user_id from events, lc where event_id <= m""")
def valid_prefix(spark, sf_dir):
    """Frames before the first that fails its check, up to the last commit."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "purchase").cast("int").alias("commit"), (F.col("value") <= 400).alias("ok"))
    return frames.committed(e, "event_id").select("event_id", "user_id")


@query("select user_id, max(event_id) as txid, max_by(value,event_id) as value from events where event_id+1 <= 5000 group by user_id")
def asof_txid(spark, sf_dir):
    return versions.as_of_txid(log(spark, sf_dir), ["user_id"], 4999).select("user_id", "txid", "value")


@query("select user_id, max(event_id) as txid, max_by(value,event_id) as value from events where ts <= timestamp '2024-01-10 12:00:00' group by user_id")
def asof_ts(spark, sf_dir):
    return versions.as_of_time(log(spark, sf_dir), ["user_id"], ntz("2024-01-10 12:00:00")).select("user_id", "txid", "value")


@query("select user_id, max(event_id) as txid, max_by(value,event_id) as value from events group by user_id")
def latest(spark, sf_dir):
    return versions.latest(log(spark, sf_dir).select("user_id", "txid", "value"), ["user_id"])


@query("select date_trunc('hour',ts) as win, user_id, max(event_id) as txid, max_by(value,event_id) as value from events group by date_trunc('hour',ts), user_id")
def compact_l1_1h(spark, sf_dir):
    return tiers.rolled_up(log(spark, sf_dir), ["user_id"], "hour").select("win", "user_id", "txid", "value")


@query("select event_id, cast(floor(epoch_us(ts)/30000000)*30 as bigint) as boundary from events")
def floor_30s(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.epoch_floor(F.col("ts"), 30).alias("boundary"))


@query("select min(event_id)+1 as min_txid, max(event_id)+1 as max_txid, count(distinct user_id) as pages, count(*) as frames, cast(floor(event_id/50) as bigint) as sync_no from events group by floor(event_id/50)")
def txid_span(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("event_id") / 50).alias("sync_no"))
    return e.groupBy("sync_no").agg((F.min("event_id") + 1).alias("min_txid"), (F.max("event_id") + 1).alias("max_txid"), F.count_distinct("user_id").alias("pages"), F.count("*").alias("frames"))


@query(f"""with {_CAT}, s as (select *, row_number() over(partition by level order by min_txid desc,max_txid desc) as rn from cat)
select level,min_txid,max_txid from s where created_at < timestamp '2024-01-25' and rn > 1""")
def snapshot_retention(spark, sf_dir):
    return retention.snapshots(catalog(spark, sf_dir), ntz("2024-01-25 00:00:00")).select("level", "min_txid", "max_txid")


@query(f"""with {_CAT}, s as (select *, row_number() over(partition by level order by min_txid desc,max_txid desc) as rn from cat)
select level,min_txid,max_txid from s where max_txid < 6000 and rn > 1""")
def txid_retention(spark, sf_dir):
    return retention.below(catalog(spark, sf_dir), 6000).select("level", "min_txid", "max_txid")


@query(f"with {_CAT} select coalesce(min(case when created_at >= timestamp '2024-01-20' then max_txid end), 0) as min_retained from cat")
def min_retained(spark, sf_dir):
    return retention.min_retained(catalog(spark, sf_dir), ntz("2024-01-20 00:00:00"))


def _l0_sql(cutoff: str) -> str:
    return f"""with {_CAT}, l1 as (select max(max_txid) as m from cat where level=1),
s as (select c.*, max(case when created_at > timestamp '{cutoff}' then 1 else 0 end) over(order by min_txid,max_txid rows between unbounded preceding and current row) as stopped,
 max(case when created_at > timestamp '{cutoff}' then 1 else 0 end) over() as any_new, row_number() over(order by min_txid desc,max_txid desc) as rn from cat c where level=0)
select min_txid,max_txid from s, l1 where stopped=0 and max_txid <= m and (any_new=1 or rn>1)"""


@query(_l0_sql("2024-01-18"))
def l0_retention(spark, sf_dir):
    return retention.level0(catalog(spark, sf_dir), ntz("2024-01-18 00:00:00")).select("min_txid", "max_txid")


@query(_l0_sql("2030-01-01"))
def l0_retention_all_old(spark, sf_dir):
    return retention.level0(catalog(spark, sf_dir), ntz("2030-01-01 00:00:00")).select("min_txid", "max_txid")


def _plan_sql(where: str) -> str:
    return f"""with recursive {_CAT}, c2 as (select * from cat where {where}), pts as (select distinct max_txid as pos from c2 union select 0),
hops as (select pos, max_txid as nxt, level, min_txid from (select p.pos, f.*, row_number() over(partition by p.pos order by f.max_txid desc,f.level desc,f.min_txid desc) as rn from pts p join c2 f on f.min_txid <= p.pos+1 and f.max_txid > p.pos) where rn=1),
r(step,pos,level,min_txid,max_txid) as (select 1, nxt, level, min_txid, nxt from hops where pos=0 union all select r.step+1, x.nxt, x.level, x.min_txid, x.nxt from r join hops x on x.pos=r.pos)
select step,level,min_txid,max_txid from r"""


@query(_plan_sql("true"))
def plan_restore(spark, sf_dir):
    return restore.plan_frame(catalog(spark, sf_dir), or_none=True)


@query(_plan_sql("not (level = 0 and created_at >= timestamp '2024-01-25' and created_at < timestamp '2024-01-26')"))
def plan_restore_gap(spark, sf_dir):
    """A missing file ends the chain."""
    hole = (F.col("level") == 0) & (F.col("created_at") >= ntz("2024-01-25 00:00:00")) & (F.col("created_at") < ntz("2024-01-26 00:00:00"))
    return restore.plan_frame(catalog(spark, sf_dir).where(~hole), or_none=True)


_GAPS = "select min_txid,max_txid, (min_txid > prev_max+1 or max_txid <= prev_max) as broken from g where prev_max is not null"


@query(f"with {_CAT}, g as (select min_txid, max_txid, lag(max_txid) over(order by min_txid,max_txid) as prev_max from cat where level=0) {_GAPS}")
def gaps(spark, sf_dir):
    return frames.gaps(catalog(spark, sf_dir).where("level = 0")).select("min_txid", "max_txid", "broken")


@query(f"with {_CAT}, g as (select min_txid, max_txid, lag(max_txid) over(order by min_txid,max_txid) as prev_max from cat where level=0 and day(created_at) <> 10) {_GAPS}")
def gaps_broken(spark, sf_dir):
    return frames.gaps(catalog(spark, sf_dir).where("level = 0").where(F.dayofmonth("created_at") != 10)).select("min_txid", "max_txid", "broken")


@query(f"with {_CAT} select level, min_txid, max_txid from cat where level = 0 and min_txid > (select coalesce(max(max_txid), 0) from cat where level = 1)")
def frontier(spark, sf_dir):
    return tiers.frontier(catalog(spark, sf_dir), 0, 1).select("level", "min_txid", "max_txid")


@query(f"with {_CAT} select level, count(*) as files, max(max_txid) as max_txid, lower(lpad(to_hex(level), 4, '0')) || '/' || lpad(lower(to_hex(min(min_txid))), 16, '0') || '-' || lpad(lower(to_hex(max(max_txid))), 16, '0') || '.ltx' as name from cat group by level")
def catalog_span(spark, sf_dir):
    got = catalog(spark, sf_dir).groupBy("level").agg(F.count("*").alias("files"), F.max("max_txid").alias("max_txid"), F.min("min_txid").alias("lo"))
    return got.select("level", "files", "max_txid", F.concat(C.level_dir(F.col("level")), F.lit("/"), C.file_name(F.col("lo"), F.col("max_txid"))).alias("name"))


@query("select event_type, bit_xor(('0x'||substr(md5(concat(cast(event_id as varchar),'|',cast(user_id as varchar))),1,15))::bigint) as chk from events group by event_type")
def rolling_xor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"))
    return e.groupBy("event_type").agg(F.bit_xor(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")).alias("chk"))


def _outcome_sql(body: str, keys: str, source: str) -> str:
    return f"""select {keys},count(*) as writes,count(distinct {body}) as versions,
case when count(*)=1 then 'Created' when count(distinct {body})=1 then 'AlreadyIdentical' else 'Conflict' end as outcome from {source} group by {keys}"""


@query(_outcome_sql("concat_ws('|',cast(l_partkey as varchar),cast(l_suppkey as varchar),l_returnflag)", "l_orderkey,l_linenumber", "lineitem"))
def equivocation(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return frames.outcomes(x, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_returnflag"])


@query(_outcome_sql("concat_ws('|',cast(l_returnflag as varchar))", "l_orderkey,l_linenumber", "lineitem"))
def equivocation_identical(spark, sf_dir):
    return frames.outcomes(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey", "l_linenumber"], ["l_returnflag"])


def _half(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(first event_id of the upper half of the ids, first one beyond all)."""
    n = table(spark, sf_dir, "events").agg(F.coalesce(F.max("event_id") + 1, F.lit(0))).first()[0]
    return (n + 1) // 2, n


_HALF_SQL = "h as (select (max(event_id) + 2) // 2 as cut, max(event_id) + 1 as n from events)"


@query(f"""with {_HALF_SQL}, r as (select user_id, value, event_id, event_id >= cut as late, row_number() over(partition by user_id, event_id >= cut order by event_id desc) as rn from events, h),
inc as (select user_id, value, event_id from r where late and rn = 1), base as (select user_id, value, event_id from r where not late and rn = 1)
select * from inc union all select * from base b where not exists (select 1 from inc where inc.user_id = b.user_id)""")
def newest_first(spark, sf_dir):
    """The upper half of the ids before the lower."""
    e = table(spark, sf_dir, "events").select("user_id", "value", "event_id")
    cut, _ = _half(spark, sf_dir)
    return versions.newest_first([versions.latest(e.where(w), ["user_id"], "event_id") for w in (F.col("event_id") >= cut, F.col("event_id") < cut)], ["user_id"])


@query("""with s as (select 0 as step, user_id as pgno, max_by(value, event_id) as data from events where event_id < 3000 group by user_id
 union all select 1, user_id, max_by(value, event_id) from events where event_id >= 3000 and event_id < 6000 and user_id <= 60 group by user_id
 union all select 2, user_id, max_by(value, event_id) from events where event_id >= 6000 group by user_id)
select pgno, max_by(data, step) as data from s where (step = 2 or pgno <= 60) group by pgno""")
def merge_shrunk(spark, sf_dir):
    """Three files; the second shrinks the database to 60 pages, the third grows it again."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pgno"), "event_id", F.col("value").alias("data"))
    cuts = [e.where("event_id < 3000"), e.where("event_id >= 3000 and event_id < 6000 and pgno <= 60"), e.where("event_id >= 6000")]
    return versions.merged([versions.latest(x, ["pgno"], "event_id").select("pgno", "data") for x in cuts], [2**31, 60, 2**31]).select("pgno", "data")


@query("""select s.i as pgno, coalesce(c.value, b.value, -1.0::double) as data from (select unnest(range(1, max(user_id) + 101)) as i from events) s
left join (select user_id, max_by(value, event_id) as value from events where event_id >= 4000 group by user_id) c on c.user_id = s.i
left join (select user_id, max_by(value, event_id) as value from events where event_id < 4000 group by user_id) b on b.user_id = s.i""")
def overlay(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pgno"), "event_id", F.col("value").alias("data"))
    new, old = (versions.latest(e.where(w), ["pgno"], "event_id") for w in ("event_id >= 4000", "event_id < 4000"))
    blank = F.lit(-1.0)
    size = table(spark, sf_dir, "events").agg(F.coalesce(F.max("user_id"), F.lit(0))).first()[0] + 100
    return versions.overlaid(old, new, size, 4096, blank=blank)


@query("select cast(floor(event_id/500) as bigint) as tick, max(event_id)+1 as live, case when max(event_id)+1 >= 8000 then 'TRUNCATE' when max(event_id)+1 >= 1000 then 'PASSIVE' else 'NONE' end as mode from events group by floor(event_id/500)")
def ckpt_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 500).alias("tick"))
    return e.groupBy("tick").agg((F.max("event_id") + 1).alias("live")).withColumn("mode", C.checkpoint_mode(F.col("live"), truncate=8000))


@query("""with f as (select * from (values (24),(144),(1440)) as t(f0)), d as (select f0, f0+least(24,f0)+1+1+10 as a, f0+least(least(24,f0),24)+3+1 as b from f)
select f0::bigint as f0, a::bigint as class_a, b::bigint as class_b, (a*100*30)::bigint as a_month, (b*100*30)::bigint as b_month, round(a::double*3000/1000.0::double*0.005::double + b::double*3000/1000.0::double*0.0004::double,2) as usd from d""")
def ops_cost(spark, sf_dir):
    """Store operations of 100 databases over 30 days, by change files a day."""
    f = spark.range(1).select(F.explode(F.array(*(F.lit(x).cast("long") for x in (24, 144, 1440)))).alias("f0"))
    merged = F.least(F.lit(24), F.col("f0"))
    d = f.select("f0", (F.col("f0") + merged + 12).cast("long").alias("class_a"), (F.col("f0") + F.least(merged, F.lit(24)) + 4).cast("long").alias("class_b"))
    usd = F.round(F.col("class_a").cast("double") * 3000 / 1000.0 * 0.005 + F.col("class_b").cast("double") * 3000 / 1000.0 * 0.0004, 2)
    return d.select("f0", "class_a", "class_b", (F.col("class_a") * 3000).alias("a_month"), (F.col("class_b") * 3000).alias("b_month"), usd.alias("usd"))


@query(_plan_sql("max_txid <= 4000"))
def plan_restore_txid(spark, sf_dir):
    """The chain that restores transaction 4000 or the last before it that a file ends on, no steps if none does; the catalog is filtered first."""
    return restore.plan_frame(catalog(spark, sf_dir).where("max_txid <= 4000"), or_none=True)


@query(_plan_sql("max_txid <= (select max(max_txid) from cat where created_at <= timestamp '2024-01-20 06:00:00')"))
def plan_restore_time(spark, sf_dir):
    """As of a time: the greatest transaction written by then, and the chain up to it."""
    cat = catalog(spark, sf_dir)
    top = tiers.reached(cat, ntz("2024-01-20 06:00:00"))
    return restore.plan_frame(cat.join(F.broadcast(top), F.col("max_txid") <= F.col("reached")), or_none=True)  # top is one row


@query(f"with {_CAT} select max(max_txid) as reached from cat where created_at <= timestamp '2024-01-10 12:00:00'")
def asof_target(spark, sf_dir):
    return tiers.reached(catalog(spark, sf_dir), ntz("2024-01-10 12:00:00"))


@query(f"""with {_CAT}, pts as (select distinct max_txid as pos from cat union select 0)
select pos, level, min_txid, max_txid from (select p.pos, f.*, row_number() over(partition by p.pos order by f.max_txid desc,f.level desc,f.min_txid desc) as rn
 from pts p join cat f on f.min_txid <= p.pos+1 and f.max_txid > p.pos) where rn=1""")
def next_hops(spark, sf_dir):
    """From every position the file that reaches furthest."""
    return restore.hops(catalog(spark, sf_dir))


@query(f"with {_CAT} select (select max(max_txid) from cat) as txid, max(max_txid) as l0_txid, max_by(created_at, max_txid) as l0_created_at from cat where level = 0")
def position(spark, sf_dir):
    """Where replication resumes: the greatest transaction of all levels, and the newest file of level 0."""
    zero = F.col("level") == 0
    return catalog(spark, sf_dir).agg(F.max("max_txid").alias("txid"), F.max(F.when(zero, F.col("max_txid"))).alias("l0_txid"), F.max_by("created_at", F.when(zero, F.col("max_txid"))).alias("l0_created_at"))


@query(f"with {_CAT} select min_txid, max_txid from (select *, row_number() over(order by min_txid desc, max_txid desc) as rn from cat where level = 0) where rn > 1")
def legacy_inputs(spark, sf_dir):
    """Level-0 files that a one-step compaction folds in: all but the newest."""
    return retention.but_newest(catalog(spark, sf_dir).where("level = 0")).select("min_txid", "max_txid")


@query(f"""with {_CAT}, s as (select *, row_number() over(partition by level order by min_txid desc,max_txid desc) as rn from cat)
select level, min_txid, max_txid from s where not (created_at < timestamp '2024-01-25' and rn > 1)""")
def retained_files(spark, sf_dir):
    """The catalog without what snapshot retention deletes."""
    cat = catalog(spark, sf_dir)
    return retention.without(cat, retention.snapshots(cat, ntz("2024-01-25 00:00:00"))).select("level", "min_txid", "max_txid")


@query(f"""with {_CAT} select level, count(*) as inputs, min(min_txid) as min_txid, max(max_txid) as max_txid, sum(max_txid - min_txid + 1)::bigint as transactions from cat
where level = 0 and min_txid > (select coalesce(max(max_txid), 0) from cat where level = 1) group by level""")
def backlog(spark, sf_dir):
    """What waits for the next compaction of level 1."""
    f = tiers.frontier(catalog(spark, sf_dir), 0, 1)
    return f.groupBy("level").agg(F.count("*").alias("inputs"), F.min("min_txid").alias("min_txid"), F.max("max_txid").alias("max_txid"), F.sum(F.col("max_txid") - F.col("min_txid") + 1).alias("transactions"))


@query(f"with {_CAT} select level, min_txid, max_txid, (min_txid = 1) as is_snapshot, (min_txid > 0 and max_txid >= min_txid) as valid from cat")
def header_checks(spark, sf_dir):
    lo, hi = F.col("min_txid"), F.col("max_txid")
    return catalog(spark, sf_dir).select("level", "min_txid", "max_txid", C.is_snapshot(lo).alias("is_snapshot"), C.is_txid_range(lo, hi).alias("valid"))


@query(f"""with {_CAT} select '/replica/' || lower(lpad(to_hex(level), 4, '0')) || '/' || lpad(lower(to_hex(min_txid)), 16, '0') || '-' || lpad(lower(to_hex(max_txid)), 16, '0') || '.ltx' as path,
level, min_txid, max_txid from cat""")
def key_names(spark, sf_dir):
    """Keys of the store, built and read again."""
    path = F.concat(F.lit("/replica/"), C.level_dir(F.col("level")), F.lit("/"), C.file_name(F.col("min_txid"), F.col("max_txid")))
    level, low, high = C.parse_file_name(F.col("path"))
    return catalog(spark, sf_dir).select(path.alias("path")).select("path", level.alias("level"), low.alias("min_txid"), high.alias("max_txid"))


@query("""with s as (select distinct ((1 << (event_id % 20)::int) + event_id % 2)::bigint as size from events)
select size, (size between 512 and 65536 and bit_count(size) = 1) as valid, (1073741824 // size + 1)::bigint as lock_pgno from s""")
def page_sizes(spark, sf_dir):
    n = F.col("size")
    sizes = table(spark, sf_dir, "events").select((F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("event_id") % 20).cast("int")) + F.col("event_id") % 2).alias("size")).distinct()
    return sizes.select("size", C.is_page_size(n).alias("valid"), C.lock_page(n).alias("lock_pgno"))


@query("select event_id, epoch_us(ts) // 1000 as from_text, epoch_us(ts) // 1000 as from_number, true as junk_is_null from events")
def parse_times(spark, sf_dir):
    """Times given as RFC 3339 text or as epoch milliseconds, parts of a millisecond cut off; anything else is null."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    number = F.unix_millis(F.to_timestamp_ltz(text)).cast("string")
    return table(spark, sf_dir, "events").select("event_id", C.timestamp_ms(text).alias("from_text"), C.timestamp_ms(number).alias("from_number"), C.timestamp_ms(F.concat(F.lit("t"), number)).isNull().alias("junk_is_null"))


@query("select floor(event_id/500)::bigint as tick, (32 + count(*) * 4120)::bigint as wal_offset, count(*) as live from events group by floor(event_id/500)")
def live_frames(spark, sf_dir):
    ticks = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).alias("tick")).agg((F.count("*") * 4120 + 32).alias("wal_offset"))
    return ticks.select("tick", "wal_offset", C.live_frames(F.col("wal_offset"), F.lit(4096)).alias("live"))


@query("select floor(event_id/50)::bigint as sync_no, user_id + 1 as pgno, max(event_id) as frame_no, max_by(value, event_id) as data from events group by floor(event_id/50), user_id")
def incremental_pages(spark, sf_dir):
    """Pages of each change file: a page's last version within its 50 frames."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 50).alias("sync_no"), (F.col("user_id") + 1).alias("pgno"), F.col("event_id").alias("frame_no"), F.col("value").alias("data"))
    return versions.latest(e, ["sync_no", "pgno"], "frame_no")


@query("""select (event_id // 1000)::bigint as file_no, count(distinct user_id) as pages, min(user_id) + 1 as first_page, max(user_id) + 1 as last_page,
(min(user_id) = 0 and max(user_id) + 1 = count(distinct user_id)) as whole from events group by event_id // 1000""")
def snapshot_check(spark, sf_dir):
    """Whether each file's pages run from 1 on without a gap."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("file_no"), (F.col("user_id") + 1).alias("pgno"))
    return frames.wholeness(e, ["file_no"])


@query("""with f as (select 0 as step, user_id from events where event_id < 3000 union all select 1, user_id from events where event_id >= 3000 and event_id < 6000 union all select 2, user_id from events where event_id >= 6000)
select user_id as pgno, max(step) as step from f group by user_id""")
def page_lookup(spark, sf_dir):
    """For each page the newest file whose index has it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("pgno"), F.when(F.col("event_id") < 3000, 0).when(F.col("event_id") < 6000, 1).otherwise(2).alias("step"))
    return versions.latest(e, ["pgno"], "step")


@query(f"""with {_HALF_SQL}, f as (select event_id, user_id + 1 as pgno, case when event_id < cut then 1 else cut + 1 end as min_txid, case when event_id < cut then cut else n end as max_txid from events, h)
select min_txid::bigint as min_txid, max_txid::bigint as max_txid, pgno, max(event_id)::varchar as data from f group by min_txid, max_txid, pgno""")
def ltx_files(spark, sf_dir):
    """Two change files, one for each half of the ids, written by the sink ``ltx`` under the shared folder and read by the source with their checksums verified."""
    cut, n = _half(spark, sf_dir)
    return _written(spark, sf_dir, [(0, cut), (cut, n)])


def _written(spark: SparkSession, sf_dir: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Pages of files of these event ids (end exclusive), written and read again."""
    datasources.register(spark)
    root = f"{shared_dir(spark)}/palimpsest/ltx-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select((F.col("user_id") + 1).alias("pgno"), F.col("event_id"))
    for low, high in ranges:
        pages = versions.latest(e.where((F.col("event_id") >= low) & (F.col("event_id") < high)), ["pgno"], "event_id")
        pages = pages.select("pgno", F.rpad(F.col("event_id").cast("string"), 512, " ").cast("binary").alias("data"))
        how = {"path": root, "level": 0, "page_size": 512, "commit": 2**31 - 1, "min_txid": low + 1, "max_txid": high}
        pages.coalesce(1).write.format("ltx").options(**how).mode("append").save()
    got = spark.read.format("ltx").option("path", root).option("verify", "true").load()
    return got.select("min_txid", "max_txid", "pgno", F.rtrim(F.col("data").cast("string")).alias("data"))
