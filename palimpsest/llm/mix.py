"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a token target. A source whose target is several times its size is taken whole so many times (complete epochs);
the rest is selected by exponential keys -ln(u) / quality, smallest first, until the words add up. The document on the boundary
gives part of its words.

Nothing sorts a whole source: sums by range of keys (pre-aggregated) show which range holds the boundary, that range is cut again
until it holds ``BUCKET`` documents or fewer, and only these are sorted. What a document gives then follows from its source's
boundary key alone, so the result is a join with one row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import cut, drop, scope
from ..tables import table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEAT = 1.5, 2
BUCKET, BINS = 4096, 4096
SEED = "mix"
_JUNK = "[#*$%&|<>!0-9]"


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def quality(text: Column) -> Column:
    """Sampling weight from 0.05 to 1: less for symbols and digits."""
    t = F.coalesce(text, F.lit(""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * F.regexp_count(t, F.lit(_JUNK)) / F.greatest(F.length(t), F.lit(1)))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with size (words), weight_ and the exponential key_."""
    df = docs.withColumns({"size": n_words(F.col("text")), "weight_": quality(F.col("text"))})
    name = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return df.withColumn("key_", -F.log(u) / F.col("weight_"))


def targets(slim: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n, target): shares by weight, none above its limit; what is above goes to the others by weight.

    The windows run over one row a source. Sources are sorted by limit over weight: the full ones come first, and the level at
    which the others stand is that of the first source it doesn't fill.
    """
    by = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    named = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    df = by.withColumn("w", w).withColumn("limit", (F.col("source_size") * max_repeat).cast("double"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("w"), F.asc_nulls_last("source"))
    df = df.withColumns(
        {
            "budget": F.sum("source_size").over(every) * F.lit(share),
            "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "nth": F.row_number().over(order),
        }
    )
    df = df.withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    df = df.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("nth"))).over(every))
    return df.select("source", "source_size", "n", F.coalesce(F.least("limit", F.col("w") * F.col("level")), F.col("limit")).alias("target"))


def _boundaries(slim: DataFrame, src: DataFrame) -> DataFrame:
    """(source, rest, low, high, start_, n): of each source the range of keys that holds the boundary, and the words before it.

    The range is cut in ``BINS`` by key and the one that holds the boundary is taken, until none holds over ``BUCKET`` rows or only
    one key is left. Sums are pre-aggregated; a round reads what is left of the range before.
    """
    me = src.select(F.col("source").alias("s_"), "rest")
    whole = slim.groupBy("source").agg(F.min("key_").alias("low"), F.max("key_").alias("high"), F.sum("size").alias("words"), F.count("*").alias("n"))
    now = whole.join(me, whole["source"].eqNullSafe(me["s_"])).where("rest < words").select("source", "rest", "low", "high", F.lit(0).cast("long").alias("start_"), "n")
    now = cut(now, "ranges")
    while not now.where((F.col("n") > BUCKET) & (F.col("low") < F.col("high"))).isEmpty():
        known = now.select(F.col("source").alias("s_"), "rest", "low", "high", "start_")
        rows = slim.join(known, slim["source"].eqNullSafe(known["s_"]) & slim["key_"].between(F.col("low"), F.col("high")))
        width = F.col("high") - F.col("low")
        bin_ = F.when(width > 0, F.least(F.floor((F.col("key_") - F.col("low")) / width * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        sums = rows.groupBy("source", "rest", "start_", bin_.alias("bin")).agg(F.min("key_").alias("low"), F.max("key_").alias("high"), F.sum("size").alias("words"), F.count("*").alias("n"))
        order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows
        sums = sums.withColumn("start_", F.col("start_") + F.sum("words").over(order) - F.col("words"))
        new = cut(sums.where("start_ <= rest and rest < start_ + words").select("source", "rest", "low", "high", "start_", "n"), "ranges")
        drop(now)
        now = new
    return now


def plan(slim: DataFrame, **how) -> DataFrame:
    """One row a source: source_size, target, epochs, and the boundary (edge_key, edge_id, edge_size) with the words each row on it gives."""
    src = cut(targets(slim, **how), "targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    src = src.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    spot = _boundaries(slim, src.select("source", "rest"))
    near = slim.join(spot.select(F.col("source").alias("s_"), "rest", "low", "high", "start_"), slim["source"].eqNullSafe(F.col("s_")) & slim["key_"].between(F.col("low"), F.col("high")))
    runs = near.groupBy("source", "rest", "start_", "key_", "doc_id", "size").count()
    order = Window.partitionBy("source").orderBy("key_", F.asc_nulls_first("doc_id"), "size")
    all_ = F.col("size") * F.col("count")
    runs = runs.withColumn("start_", F.col("start_") + F.sum(all_).over(order) - all_).where("start_ <= rest").where(F.col("rest") < F.col("start_") + all_)
    edges = runs.select(F.col("source").alias("s_"), F.struct("key_", F.col("doc_id").isNotNull().alias("has"), "doc_id", "size").alias("edge"), F.floor((F.col("rest") - F.col("start_")) / F.col("count")).cast("long").alias("edge_words"))
    return src.join(edges, src["source"].eqNullSafe(edges["s_"]), "left").select("source", "source_size", "target", "epochs", "rest", "edge", "edge_words")


def taken(df: DataFrame, sources: DataFrame) -> DataFrame:
    """``df`` (from ``measured``) with source_size, target, epochs, part (words of the fractional epoch) and taken."""
    named = sources.withColumnRenamed("source", "source__")
    me = F.struct("key_", F.col("doc_id").isNotNull().alias("has"), "doc_id", "size")
    part = F.when(F.col("rest") >= F.col("source_size"), F.col("size")).when(F.col("edge").isNull(), F.lit(0)).when(me < F.col("edge"), F.col("size")).when(me == F.col("edge"), F.col("edge_words")).otherwise(F.lit(0)).cast("long")
    joined = df.join(named, df["source"].eqNullSafe(named["source__"])).withColumn("part", part)
    return joined.withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a row for each epoch, and the boundary document's copy cut after its last word.

    Null texts have no words and are never taken; a null source is a source of its own, the last. Repeated rows on the boundary
    share its words evenly, rounded down. Reruns agree.
    """
    wide = docs.select(F.struct(*docs.columns).alias("row_"), "doc_id", "source", "text")
    sized, sources = _planned(measured(wide).select("row_", "doc_id", "source", "size", "key_"))
    got = taken(sized, sources).withColumn("text", F.col("row_.text"))
    copies = F.col("epochs") + (F.col("part") > 0).cast("long")
    got = got.withColumn("copy_", F.explode_outer(F.when((copies > 0) & (F.col("size") > 0), F.sequence(F.lit(1).cast("long"), copies)))).where("copy_ is not null")
    cut_ = (F.col("copy_") > F.col("epochs")) & (F.col("part") < F.col("size"))
    head = F.array_join(F.slice(F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    text = F.when(cut_, head).otherwise(F.col("text"))
    own = {"text": text}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(cut_, F.length(head).cast("long")).otherwise(F.col("row_.n_chars"))
    return got.select(*(own.get(c, F.col(f"row_.`{c}`")).alias(c) for c in docs.columns))


def _planned(sized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``sized``, its ``plan``), both written; what the plan needed on the way is deleted."""
    with scope(sized.sparkSession) as keep:
        sized = keep(cut(sized, "sizes"))
        return sized, keep(cut(plan(sized.select("doc_id", "source", "size", "key_")), "sources"))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return taken(*_planned(measured(docs).select("doc_id", "source", "size", "key_"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix": op4_mix}
ORACLE_SQL = {
    "op4_mix": r"""
with m as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    greatest(0.05::double, 1.0::double - 4.0::double * coalesce(len(regexp_extract_all(text, '[#*$%&|<>!0-9]')), 0) / greatest(coalesce(length(text), 0), 1)) as weight
  from documents),
k as (select *, -ln((('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|' || size::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / weight as key from m),
s as (select source, sum(size)::bigint as source_size from k group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int] as w, (source_size * 2)::double as lim from s),
o as (select *, (sum(source_size) over ())::double * 1.5::double as budget,
    coalesce(sum(lim) over (order by lim / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by lim / w, source nulls last rows between current row and unbounded following) as rest_w,
    row_number() over (order by lim / w, source nulls last) as nth from w),
l as (select *, (budget - before) / rest_w as level from o),
t as (select source, source_size, coalesce(least(lim, w * (select level from l where level <= lim / w order by nth limit 1)), lim) as target from l),
e as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from t),
r as (select *, round(target - epochs * source_size)::bigint as rest from e),
p as (select k.doc_id, k.size, r.source_size, r.target, r.epochs, r.rest, sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows unbounded preceding) - k.size as start
  from k join r on k.source is not distinct from r.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::bigint as taken from p"""
}
