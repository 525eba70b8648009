"""Document quality: rules vote or abstain and a posterior probability decides, instead of a filter that all rules must pass.

All DataFrame expressions. Pass one counts words, symbols, repeated lines and windows of each whole text and sums up vote
patterns; EM over these at most 3 ** 8 counts (``weak``) runs in the driver; pass two turns votes to a posterior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from ..tables import table
from . import weak
from .barrier import held

WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages; a word list, fixed.
STOPWORDS = (
    "the of and to in is that it was for on are with as be this by from at a an or have not he they "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et du en un une que qui dans pour par sur au avec est pas "
    "el los las del que y se con por una para no su al lo es"
)
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
KEEP_AT = 0.5


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_stop, n_shout (words that end in "!"), n_bar.

    Nulls count as empty text. Repeats are found by the words' hashes, sorted: time n log n in a text's own length. Columns of these
    names are replaced, and those named w_, lines_, h_, x2_, x_, s_, p_ and repeats_ are lost.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(t, "[ \\t-\\r]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = docs.withColumns({"w_": words, "lines_": lines})
    df = df.withColumn("h_", F.transform("w_", lambda w: F.xxhash64(w)))
    n = F.size("w_")
    two = F.zip_with("h_", F.slice("h_", 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("x2_", two)
    four = F.zip_with("x2_", F.slice("x2_", 3, n), lambda a, b: F.xxhash64(a, b))
    five = F.zip_with(four, F.slice("h_", 5, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("x_", F.slice(five, 1, F.greatest(n - (WINDOW - 1), F.lit(0))))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("w_", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_lines": F.size("lines_").cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit("\\p{Lu}")).cast("long"),
            "n_stop": F.size(F.filter("w_", lambda w: w.isin(sorted(set(STOPWORDS.split()))))).cast("long"),
            "n_shout": F.regexp_count(t, F.lit("!(?=[ \\t-\\r]|$)")).cast("long"),
            "n_bar": F.size(F.filter("w_", lambda w: w == "|")).cast("long"),
            "repeats_": F.size(F.array_distinct("x_")) < F.size("x_"),
        }
    )
    # starts of windows that occur twice, in order; each covers the words up to the next start, five at most
    s = F.sort_array(F.transform("x_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("s_", F.when(F.col("repeats_"), s))
    hit = F.filter("s_", lambda x, j: F.get("s_", j - 1)["h"].eqNullSafe(x["h"]) | F.get("s_", j + 1)["h"].eqNullSafe(x["h"]))
    df = df.withColumn("p_", F.when(F.col("repeats_"), F.array_sort(F.transform(hit, lambda x: x["i"]))))
    covered = F.aggregate(F.transform("p_", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p_", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.when(F.col("repeats_"), covered).otherwise(F.lit(0)).cast("long"))
    return df.drop("w_", "lines_", "h_", "x2_", "x_", "s_", "p_", "repeats_")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(0)).when(good, F.lit(1)).otherwise(F.lit(weak.ABSTAIN))


def votes() -> list[Column]:
    """One column a rule over ``features``: 1 good, 0 bad, -1 abstains."""
    n, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    few = F.col("n_words") < MIN_WORDS
    return [
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_symbols") * 50 <= n, F.col("n_symbols") * 10 > n)),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_repeat_words") * 20 <= n, F.col("n_repeat_words") * 5 > n)),
        F.when(lines < 3, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_dup_lines") * 20 <= lines, F.col("n_dup_lines") * 4 > lines)),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_upper") * 10 <= chars, F.col("n_upper") * 4 > chars)),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_stop") * 10 >= n, F.col("n_stop") * 50 < n)),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote((chars >= 3 * n) & (chars <= 9 * n), (chars < 2 * n) | (chars > 14 * n))),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_shout") * 50 <= n, F.col("n_shout") * 10 > n)),
        F.when(few, F.lit(weak.ABSTAIN)).otherwise(_vote(F.col("n_bar") * 50 <= n, F.col("n_bar") * 10 > n)),
    ]


def fit(feats: DataFrame) -> weak.Model:
    """EM over the counts of vote patterns of all rows of ``feats``; at most 3 ** 8 counts reach the driver."""
    names = [f"v{i}" for i in range(len(votes()))]
    got = feats.select(*(v.alias(k) for v, k in zip(votes(), names, strict=True))).groupBy(*names).count().collect()
    return weak.fit([(tuple(r[k] for k in names), r["count"]) for r in got], len(names), prior=0.8, start=(0.95, 0.35))


def judged(feats: DataFrame, model: weak.Model) -> DataFrame:
    """Adds p_good, base_failed and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.log_odds_column(votes())))
    return feats.withColumns({"p_good": p, "base_failed": failed}).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns, whatever their names. Texts are read once and never shuffled.

    Null and empty texts have no words and go. Repeated rows are judged alike. The features are written beside the rows, so the
    sums over vote patterns read only them.
    """
    wide = docs.select(F.struct(*docs.columns).alias("row_"), F.col("text").alias("text_"))
    feats = cut(features(wide, "text_").drop("text_"), "quality")
    return held(judged(feats, fit(feats)), F.col("kept")).select("row_.*")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    feats = cut(features(docs).drop("text"), "quality")
    return judged(feats, fit(feats)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES = {"op7_quality": op7_quality}
ORACLE_SQL: dict[str, str] = {}
