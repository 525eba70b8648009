import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import langid, licenses, media, mix, packing, pii, quality, simhash, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
TEXTS = [None, "", "  \n", "one", "the cat sat on the mat and it was the best of days for all of us here", "the cat sat on the mat and it was the best of days for all of us here", LONG, "x@y.org +1 (555) 555-0199 10.0.0.1 4111 1111 1111 1111 999.1.1.1 1234567890123", "Licensed under the Apache License, Version 2.0.", "é ñ\na b c d e a b c d e\na b c d e\n# $"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{i % 2}", None) for i, t in enumerate(TEXTS)] + [(None, "null id text", None, None, None), (4, TEXTS[4], "en", "s0", 1), (4, TEXTS[4], "en", "s0", 1)]
    # extra columns with names that the operators use themselves
    return spark.createDataFrame(rows, DOC).withColumns({"score": F.lit(1), "media": F.lit(b"x"), "kept": F.lit(True), "fp": F.lit(1), "size": F.lit("x"), "n_words": F.lit("y")})


def components(rows):
    fps = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return [min((r["doc_id"] for r, g in zip(rows, group, strict=True) if g == x and r["doc_id"] is not None), default=None) for x in group]


@pytest.mark.parametrize("bucket", [simhash.MAX_BUCKET, 8])
def test_simhash(spark, docs, bucket):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 400, 60)]
    near = [(100 + i, " ".join([*base[: i % 60], "new", *base[i % 60 :]]), "en", "s", 1) for i in range(60)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, DOC).select("doc_id", "text"))
    rows = simhash.near_duplicates(df, max_bucket=bucket).collect()
    assert len(rows) == df.count() and components(rows) == [r["component_id"] for r in rows]


def test_quality_base(docs):
    def plain(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c, cover = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)

    for r in quality.features(docs.select("doc_id", "text")).collect():
        assert plain(r["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def test_pii_base(docs):
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, m):
        d = [int(c) for c in m if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[k]

    tricky = ["a@b.c_d@e.f x@y.", "1.2.3.4.5.6.7.8", "1" * 20_000, "+1 23 4567890 - ", "a" * 5000 + "@", "..@a.b@c.d"]
    extra = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(tricky)], "doc_id long, text string")
    for r in pii.candidates(docs.select("doc_id", "text").unionByName(extra)).collect():
        want = [(i, m.start(), m.end()) for i, (k, p) in enumerate(pats.items()) for m in re.finditer(p, r["text"] or "") if ok(k, m[0])]
        assert [(x["kind"], x["s"], x["e"]) for x in r["base_"]] == want


def test_redaction(docs):
    more = docs.sparkSession.createDataFrame([(50, "é x@y.org, +1 (555) 555-0199; 10.0.0.1: 4111 1111 1111 1111. end", "en", "s", 1)], DOC)
    got = {r["doc_id"]: r for r in pii.redacted(docs.select(*more.columns).unionByName(more)).collect()}
    assert got[50]["text"] == "é <EMAIL>, <PHONE>; <IP>: <CARD>. end" and got[50]["n_chars"] == len(got[50]["text"])
    assert got[0]["text"] is None and got[6]["text"] == LONG


def test_mix(docs):
    df = docs.select("doc_id", "source", "text")
    slim = mix.measured(df).select("doc_id", "source", "size", "key_")
    rows = mix.taken(slim, mix.plan(slim)).collect()
    assert len(rows) == df.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3
    assert sorted(map(str, rows)) == sorted(map(str, mix.taken(slim, mix.plan(slim)).collect()))
    words = sum(len((r["text"] or "").split()) for r in mix.mixed(docs).collect())
    assert words == sum(r["taken"] for r in rows)


def test_packing_whole_texts(docs):
    rows = packing.packed(docs).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for (t,) in docs.select("text").collect())
    assert {r["n_tokens"] for r in rows if r["bin_id"] is None} == {0}


def test_packing_spreads_like_rows(spark):
    same = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"))
    rows = packing.packed(same, shard=1000).collect()
    shards = Counter(r["bin_id"] >> 32 for r in rows)
    assert len(rows) == 5000 and len(shards) > 1 and max(shards.values()) < 5000
    held = Counter()
    for r in rows:
        held[r["bin_id"]] += r["n_tokens"]
    assert len({(r["bin_id"], r["start"]) for r in rows}) == 5000 and all(held[r["bin_id"]] <= r["bin_size"] for r in rows)


def test_media(docs):
    rows = media.digests(media.stored(docs.select("doc_id", "text"))).collect()
    by = {r["doc_id"]: r for r in rows}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (by[i]["n_bytes"], by[i]["payload_bytes"], by[i]["payload_sha256"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
    assert by[4]["feature"] == by[5]["feature"] and by[0]["media_sha256"] == by[1]["media_sha256"]
    t = media.tensors(media.stored(docs.select("doc_id", "text", "media")).where("doc_id = 3")).first()
    assert len(t["rgb"]) == t["height"] * t["width"] * 3


def test_langid_sample_has_every_language(spark):
    copies = spark.range(20_000).select(F.lit("the same text").alias("text"), F.lit("aa").alias("lang"))
    rare = spark.range(100).select(F.concat(F.lit("other text "), F.col("id").cast("string")).alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(210).select(F.lit("x").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    long = spark.createDataFrame([(LONG, "long")], "text string, lang string")
    texts, langs = langid.sample(copies.unionByName(rare).unionByName(many).unionByName(long))
    count = Counter(langs)
    assert len(count) == 212 and 40 <= count["aa"] <= 101 and len(set(zip(texts, langs, strict=True))) == len(texts)
    assert texts[langs.index("long")] == LONG[: langid.MAX_CHARS]


def test_others_take_anything(spark, docs):
    empty = spark.createDataFrame([], DOC)
    field = langid.train(["the cat of the house"], ["en"])
    assert langid.labelled(docs.select("doc_id", "text"), field).count() == docs.count()
    assert licenses.licensed(docs).where("size(notices) > 0").count() == 1
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert toxicity.scored(docs, model).where("score between 0 and 1").count() == docs.count()
    for out in (simhash.near_duplicates(empty), quality.keep_good(empty), pii.redacted(empty), mix.mixed(empty), packing.packed(empty), media.stored(empty), licenses.licensed(empty)):
        assert out.count() == 0


def test_pipeline(spark, docs):
    clean = spark.createDataFrame([(1000 + i, " ".join(f"the {chr(97 + (i * 7 + j) % 26)}{'aeiou'[j % 5]}n of and{i}" for j in range(30)), "en", f"s{i % 3}", 1) for i in range(20)], DOC)
    df = docs.select(*clean.columns).unionByName(clean)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, "")
        kept[name] = [r["doc_id"] for r in df.collect()]
    assert set(range(1000, 1020)) <= set(kept["quality"]) and not {0, 1, 2, 3} & set(kept["quality"])
    assert len(kept["near_duplicates"]) == len(set(kept["near_duplicates"])) and kept["near_duplicates"].count(4) + kept["near_duplicates"].count(5) == 1
    assert sorted(kept["pii"]) == sorted(kept["near_duplicates"]) and set(kept["packing"]) == set(kept["mix"])
