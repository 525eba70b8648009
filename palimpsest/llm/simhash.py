"""SimHash near-duplicates: fingerprints linked at a few differing bits, joined into components.

Candidates come from pigeonring filtering. The 64 bits lie in eight segments on a ring; if two fingerprints differ in at most
three bits, some segment starts a chain in which, for every length l, the first l segments differ in at most l * 3 / 8 bits:
0, 0, 1, 1, 1, 2, 2, 3. So the first two segments are equal and the next three differ in one bit at most, which leaves two of
these three equal. A fingerprint gets a 32-bit key for each of the eight starts and three choices of the segment left out;
pairs that share a key are held against the rest of the chain, and only pairs whose chain stays within budget get the full check.

A key that holds more than ``MAX_BUCKET`` distinct fingerprints is refined: three differences can't touch all four quarters of
its free bits, so each fingerprint gets four longer keys. This ends when the free bits can't hold more values than the limit,
and stays exact. No task ever compares a larger group than that.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..staging import cut, drop, scope
from ..tables import table
from .components import connected

BITS, SEGMENTS, WIDTH = 64, 8, 8
MAX_DIFF = 3
SHINGLE = 3
MAX_BUCKET = 4096
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 200_000


def _segments(which: Iterable[int]) -> int:
    return sum(((1 << WIDTH) - 1) << (WIDTH * (i % SEGMENTS)) for i in which)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ring_keys() -> list[tuple[int, int]]:
    """(start, mask) of every key."""
    return [(i, _segments(i + j for j in range(5) if j != left_out)) for i in range(SEGMENTS) for left_out in (2, 3, 4)]


def quarters(mask: int) -> list[int]:
    """The mask with each quarter of its free bits added."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k::4]) for k in range(4)]


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text; zero for null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    counts, total = np.zeros(BITS, np.int64), 0
    last = max(1, len(words) - SHINGLE + 1)
    for at in range(0, last, _BLOCK):
        part = words[at : at + _BLOCK + SHINGLE - 1] if last > 1 else words
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)))) if len(part) >= SHINGLE else [b" ".join(part)]
        h = np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(t)) for t in texts], dtype="int64")


def _chain_masks() -> tuple[np.ndarray, np.ndarray]:
    five = np.array([_segments(range(i, i + 5)) for i in range(SEGMENTS)], np.uint64)
    seven = np.array([_segments(range(i, i + 7)) for i in range(SEGMENTS)], np.uint64)
    return five, seven


def link_sorted(group: np.ndarray, start: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each run of equal ``group``: links of at most three bits that span the run's components, as (row, root row)."""
    five, seven = _chain_masks()
    n = len(fps)
    root = np.arange(n)
    alive, d = np.arange(n), 1
    while True:
        alive = alive[alive + d < n]
        alive = alive[group[alive] == group[alive + d]]
        if not len(alive):
            break
        x = fps[alive] ^ fps[alive + d]
        viable = (np.bitwise_count(x & five[start[alive]]) <= 1) & (np.bitwise_count(x & seven[start[alive]]) <= 2)
        i = alive[viable]
        i = i[np.bitwise_count(x[viable]) <= MAX_DIFF]
        a, b = root[i], root[i + d]
        new = a != b
        if new.any():
            for p, q in set(zip(a[new].tolist(), b[new].tolist())):
                while root[p] != p:
                    p = root[p]
                while root[q] != q:
                    q = root[q]
                root[max(p, q)] = min(p, q)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
        d += 1
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (start, mask, bits, fp) sorted by key; a key's rows may span batches, so the last key waits for the next batch."""
    kept: pa.Table | None = None

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        start, mask, bits = (t.column(c).to_numpy() for c in ("start", "mask", "bits"))
        fps = t.column("fp").to_numpy().view(np.uint64)
        new = np.r_[True, (start[1:] != start[:-1]) | (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])]
        rows, roots = link_sorted(np.cumsum(new), start, fps)
        if len(rows):
            yield pa.record_batch({"a": pa.array(fps[rows].view(np.int64)), "b": pa.array(fps[roots].view(np.int64))})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([kept, t]) if kept is not None else t
        if not t.num_rows:
            continue
        key = [t.column(c).to_numpy() for c in ("start", "mask", "bits")]
        same = np.logical_and.reduce([k == k[-1] for k in key])
        whole = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        kept = t.slice(whole).combine_chunks()
        if whole:
            yield from links(t.slice(0, whole))
    if kept is not None and kept.num_rows:
        yield from links(kept)


def _keyed(fps: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    structs = [F.struct(F.lit(s).cast("int").alias("start"), F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for s, m in keys]
    return fps.select("fp", F.inline(F.array(*structs)))


def _refined(hot: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """Rows of hot keys under their four longer keys. ``keys`` are this level's, at most 24 * 4 ** level of them."""
    spark = hot.sparkSession
    longer = [(s, _signed(m), _signed(q)) for s, m in keys for q in quarters(m)]
    known = spark.createDataFrame(longer, "start int, mask long, longer long")
    return hot.join(F.broadcast(known), ["start", "mask"]).select("fp", "start", F.col("longer").alias("mask"), F.col("fp").bitwiseAND(F.col("longer")).alias("bits"))


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` that have the components of all pairs at three differing bits or fewer."""
    keys, found = ring_keys(), None
    rows = _keyed(fps, keys)
    key = ["start", "mask", "bits"]
    while True:
        hot = cut(rows.groupBy(*key).count().where(F.col("count") > max_bucket).select(*key), "hot")
        more = not hot.isEmpty() and BITS - min(m.bit_count() for _, m in keys) > max_bucket.bit_length() - 1
        cool = rows.join(hot, key, "left_anti") if more else rows
        here = cool.repartition(*key).sortWithinPartitions(*key, "fp").mapInArrow(_link_batches, "a long, b long")
        found = here if found is None else found.unionByName(here)
        if not more:
            return found.distinct()
        rows = cut(_refined(rows.join(hot, key, "left_semi"), keys), "refined")
        keys = [(s, q) for s, m in keys for q in quarters(m)]


def _labelled(fps: DataFrame, max_bucket: int) -> DataFrame:
    """(fp, root, component_id) of every fingerprint of ``fps`` (doc_id, fp); what it needed on the way is deleted."""
    with scope(fps.sparkSession) as keep:
        first = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
        roots = connected(links(first.select("fp"), max_bucket))
        labelled = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
        return keep(cut(labelled.join(least, "root").select("fp", "root", "component_id"), "labelled"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long), ``fingerprint`` (16 hex digits), ``root`` (a fingerprint of the component) and ``component_id``.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any other. Null ids are never a
    component's id unless it has no other (then null). Repeated rows and ids give one result row each. Other columns are not read.
    """
    fps = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")), "fps")
    out = fps.join(_labelled(fps, max_bucket), "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "root", "component_id")
    return out.withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, with all its columns, whatever their names.

    Ids that are null come last. Of equal ids the row with the smallest fingerprint and then hash of all columns stays; of rows equal
    in all of that any one. Fingerprints are written beside the rows, so a text is hashed once; the choice shuffles only ids and
    fingerprints, and the rows are shuffled once, to be met by the numbers of those that stay.
    """
    marked = docs.select(F.struct(*docs.columns).alias("row_"), F.col("doc_id").alias("doc_id"), fingerprint_udf("text").alias("fp"), F.xxhash64(*docs.columns).alias("hash"), F.monotonically_increasing_id().alias("number"))
    marked = cut(marked, "marked")
    slim = marked.select("doc_id", "fp", "hash", "number")
    found = slim.join(_labelled(slim.select("doc_id", "fp"), MAX_BUCKET).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "hash", "number")
    stay = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.number").alias("number"))
    return marked.join(stay, "number", "left_semi").select("row_.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLE_SQL: dict[str, str] = {}
