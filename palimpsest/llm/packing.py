"""Best-fit packing into sequences of several permitted lengths.

Pieces (documents, cut where longer than the longest length) go to shards of about ``SHARD`` by hash; pieces that are alike are
counted first and travel as rows of at most ``COPIES`` copies, so none of them can fill a shard. Each shard is packed by itself, largest first, into the open bin that leaves least room. Where none fits, the length with the least cost for each word it
is expected to hold is opened: its room beyond the piece counts as far as the shard's smaller pieces can fill it. Each shard tries
that joint choice and each permitted length by itself, keeps the cheapest, and at last every bin shrinks to the smallest length
that holds its contents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from ..tables import table
from .mix import n_words

LENGTHS = (512, 1024, 2048, 4096)
#: What a bin costs besides its length, in words.
OVERHEAD = 32
SHARD = 50_000
#: Like pieces that one row stands for at most on its way to a shard.
COPIES = 1000


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, its start there, length of each bin). Sizes from 1 to the longest length, in falling order."""
    lengths = tuple(sorted(lengths))
    fill = [0] * (lengths[-1] + 1)
    for s in sizes:
        fill[s] += s
    for s in range(1, len(fill)):
        fill[s] += fill[s - 1]

    def run(choose) -> tuple[int, list[int], list[int], list[int]]:
        open_: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
        mask, bins, starts, used, room = 0, [], [], [], []
        for s in sizes:
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = open_[r].pop()
                if not open_[r]:
                    mask &= ~(1 << r)
            else:
                b, r = len(used), choose(s)
                used.append(0)
                room.append(r)
            bins.append(b)
            starts.append(used[b])
            used[b] += s
            open_[r - s].append(b)
            if r > s:
                mask |= 1 << (r - s)
        final = [next(x for x in lengths if x >= u) for u in used]
        return sum(final) + overhead * len(final), bins, starts, final

    def joint(s: int) -> int:
        return min((x for x in lengths if x >= s), key=lambda x: ((x + overhead) / (s + min(x - s, fill[min(x - s, s)])), x))

    tries = [joint, *(lambda s, x=x: next(y for y in lengths if y >= max(s, x)) for x in lengths)]
    return min((run(f) for f in tries), key=lambda r: r[0])[1:]


def _pack_shard(key: tuple, pdf: pd.DataFrame, lengths: tuple[int, ...], overhead: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].reset_index(drop=True)
    bins, starts, final = pack(pdf["n_tokens"].tolist(), lengths, overhead)
    return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "n_tokens": pdf["n_tokens"], "bin_id": [(key[0] << 32) + b for b in bins], "bin_size": [final[b] for b in bins], "start": starts})


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, bin_id, bin_size, start), a row a piece; tokens are words.

    Null and empty texts, and texts without words, give one row with 0 tokens and a null bin. Repeated rows are packed each by
    itself. Bins never mix shards; other columns are not read.
    """
    top = max(lengths)
    size = n_words(F.col("text"))
    slim = cut(docs.select("doc_id", size.alias("n")), "lengths")
    alike = slim.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("rows_"))
    parts = alike.select("doc_id", "n", "rows_", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows_") - 1) / COPIES).cast("int"))).alias("part"))
    parts = parts.select("doc_id", "n", "part", F.least(F.lit(COPIES), F.col("rows_") - F.col("part").cast("long") * COPIES).cast("int").alias("copies"))
    pieces = parts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))).alias("piece"))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(top), F.col("n") - F.col("piece").cast("long") * top).cast("int"))
    total = slim.agg(F.sum(F.ceil(F.col("n") / top))).first()[0] or 0
    shards = max(1, -(-total // shard))
    placed = pieces.select("doc_id", "piece", "n_tokens", "copies", F.pmod(F.xxhash64("doc_id", "n", "piece", "part"), F.lit(shards)).alias("shard"))
    schema = "doc_id long, piece int, n_tokens int, bin_id long, bin_size int, start int"

    def per_shard(key, pdf):
        return _pack_shard(key, pdf, lengths, overhead)

    got = placed.groupBy("shard").applyInPandas(per_shard, schema)
    none = slim.where("n = 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_size", "int"), ("start", "int"))))
    return got.unionByName(none)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_packing": op10_packing}
ORACLE_SQL: dict[str, str] = {}
