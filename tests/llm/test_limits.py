"""Cases that the operators must not lose: long texts, many matches, odd names, and plain versions of what SQL can't express."""

import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
import zstandard as zstd
from pyspark.sql import functions as F

from palimpsest.llm import html_text, langid, licenses, mix, packing, pii, quality, scans, simhash, toxicity, weak

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ("score", "notices", "text_", "row_", "id_", "fp_", "fp", "nth_", "low_", "held_", "hash", "number", "key_", "size", "weight_", "kept", "n_words", "w_", "h_", "spans_", "base_", "more_", "copy_", "part", "taken", "url")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate([None, "", " \n", "a", "the cat and the dog of the house went to that man by this on it", "the cat and the dog of the house went to that man by this on it"])] + [(None, "x", None, None, None), (4, "the cat and the dog of the house went to that man by this on it", "en", "s", None)]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(c) for c in CLASHES})


@pytest.mark.parametrize("stage", [quality.keep_good, simhash.keep_one, pii.redacted, mix.mixed])
def test_columns_of_any_name_pass_through(odd, stage):
    out = stage(odd)
    assert out.columns == odd.columns
    assert all(r[c] == c for r in out.collect() for c in CLASHES)


def test_map_operators_keep_other_columns(spark, odd):
    model = toxicity.train(["you scum scum scum", "a river and a stone"], [1, 0])
    for out, own in ((licenses.licensed(odd), "notices"), (toxicity.scored(odd, model), "score"), (html_text.main_text(odd, "text"), "text")):
        rows = out.collect()
        assert len(rows) == odd.count() and all(r[c] == c for r in rows for c in CLASHES if c != own)
    for out in (html_text.main_text(spark.createDataFrame([], "html string")), toxicity.scored(spark.createDataFrame([], DOC), model), langid.labelled(spark.createDataFrame([], "doc_id long, text string"), langid.Field(["en"]))):
        assert out.count() == 0


# -- licenses


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("Released under the BSD License.", "BSD"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("This work is licensed under a Creative Commons Attribution 3.0 International License.", "CC-BY-3.0"),
        ("Licensed under the Apache License, Version 1.1", "Apache-1.1"),
        ("Licensed under the Apache License, Version 9.0", None),
        ("Licensed under the GNU Lesser General Public License, version 7", None),
        ("Released under the terms of the well known and widely used MIT License.", "MIT"),
        ("SPDX-License-Identifier: AGPL-3.0-or-later", "AGPL-3.0"),
        ("All rights reserved.", "All-rights-reserved"),
        ("mit der Lizenz, license of the version 2.0", None),
    ],
)
def test_license_names(text, name):
    assert [x[0] for x in licenses.scan(f"Some words. {text} Then more of them.")] == ([name] if name else [])


def test_license_scan_against_a_slow_aligner():
    """Longest common subsequences over all regions of a short text: coverage never beats them, and what they cover wholly is found."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(4)
    short = [t for t in licenses.templates() if len(t.words) <= 14]
    for _ in range(60):
        t = rng.choice(short)
        body = list(t.words)
        if rng.random() < 0.5:
            body.insert(rng.randrange(1, len(body)), "really")
        ws = [rng.choice("abcdefgh") * 3 for _ in range(4)] + body + [rng.choice("abcdefgh") * 3 for _ in range(4)]
        text = " ".join(ws)
        for name, cover, s, e in licenses.scan(text):
            inside = [w for w, _, _ in licenses.words(text[s:e])]
            assert cover <= max(lcs(inside, x.words) / len(x.words) for x in short if x.name == name) + 1e-9
        if body == list(t.words):
            assert t.name in [x[0] for x in licenses.scan(text)]


def test_full_license_texts_are_told_apart():
    for name, text, *_ in licenses.TEXTS:
        for times in (1, 2):
            assert [x[0] for x in licenses.scan("Header line. " + " More. ".join([text] * times))] == [name] * times
    assert licenses.scan("Released under the MIT License. " * 5000)[-1][0] == "MIT"


# -- html


def test_html_names_and_siblings():
    p = f"<p>{'word, ' * 5 + 'x' * 270}</p>"
    text = p[3:-4]
    assert html_text.extract(f"<div class='content has-sidebar'>{p}{p}</div>") == f"{text}\n{text}"
    assert html_text.extract(f"<div class='post-content no-comments'>{p}</div>") == text
    assert html_text.extract(f"<article>{p}<div class='no-comments'>kept</div><div class='sidebar'>x</div><div class='site-footer'>f</div></article>") == f"{text}\nkept"
    beside = html_text.extract(f"<body><article>{p}</article><div>short closing</div><ul><li>u</li></ul>loose <b>text</b> here<div><a href=x>only links</a></div></body>")
    assert beside == f"{text}\nshort closing\nu\nloose text here"


@pytest.mark.parametrize("tags", ["<div>", "<p><b>", "<ul><li>", "<b></i>", "<table><tr><td>"])
def test_html_nests_deeply(tags):
    start = time.monotonic()
    assert html_text.extract(tags * 100_000 + "deep") == "deep"
    assert time.monotonic() - start < 60


def test_html_table_against_plain_articles(spark):
    """Pages of the given kind: what stands in the article, by regular expressions."""
    art = "<article><h1>T &amp; t</h1><p><b>One<br>two  three</b></p><p>&eacute;&#233;</p></article>"
    page = f"<!DOCTYPE html><html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>no</a></li></ul></nav><div class=ad>no</div>{art}<footer>no</footer></body></html>"
    rows = [(1, page), (1, page), (2, None), (3, ""), (4, page.replace("three", "t" * 300_000))]
    got = [(r["page_id"], r["text"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()]
    plain = "T & t\nOne two three\néé"
    assert sorted(got) == sorted([(1, plain), (1, plain), (2, ""), (3, ""), (4, plain.replace("three", "t" * 300_000))])


# -- personal data


def test_running_sums_and_maxima(spark):
    rng = random.Random(2)
    lists = [[], [5], [rng.randrange(9) for _ in range(255)], [1] * 256, [rng.randrange(99) for _ in range(257)], [rng.randrange(9) for _ in range(2000)], None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    got = {r["i"]: (list(r["s"]), list(r["m"])) for r in scans.running(scans.running(df, {"s": F.col("x")}), {"m": F.col("x")}, F.greatest).collect()}
    assert got == {i: (list(itertools.accumulate(x or [])), list(itertools.accumulate(x or [], max))) for i, x in enumerate(lists)}


def test_further_spans_against_plain_python(spark):
    """Candidates that no base span overlaps, found by Python's regular expressions."""
    texts = [
        "Call (017) 555-7713. or 017-555-7713, not 017-555-77134", "me [at] site [dot] org; a.b(at)c.d.e", "123-45-6789 and 1123-45-6789", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 FR1420041010050500013M02606",
        "key " + "a1" * 250 + " end " + "Z" * 200 + "9", "x" * 300, "a1b2c3d4e5f6a1b2c3d4e5f6@x.org 4111 1111 1111 1112", "id 1234567890123456 " + "+1 555 123 4567 10.0.0.1 " * 3,
    ]
    rows = pii.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        base = [(x["s"], x["e"]) for x in r["base_"]]
        want = []
        for k, p in pii.EXTRA.items():
            for m in re.finditer(p, r["text"]):
                if k != "secret" or re.search("[0-9]", m[0]):
                    want.append((pii.KINDS.index(k), m.start(), m.end()))
        for m in re.finditer(pii.PATTERNS["card"], r["text"]):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10:
                want.append((pii.KINDS.index("card"), m.start(), m.end()))
        want = [w for w in want if not any(s < w[2] and w[1] < e for s, e in base)]
        assert sorted((x["kind"], x["s"], x["e"]) for x in r["more_"]) == sorted(want)
    by = {r["doc_id"]: r for r in rows}
    assert any(x["e"] - x["s"] == 500 for x in by[4]["more_"])


def test_many_matches_take_linear_time(spark):
    text = " ".join(f"10.0.{i % 256}.{i % 200} é a{i}@x.org" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.monotonic()
    (row,) = pii.redacted(df).collect()
    assert row["text"] == " ".join(["<IP> é <EMAIL>"] * 20_000) and time.monotonic() - start < 90


def test_overlapping_spans_are_replaced_together(spark):
    spans = "array(named_struct('kind', 0, 's', 2, 'e', 600), named_struct('kind', 1, 's', 10, 'e', 1200), named_struct('kind', 3, 's', 1200, 'e', 1201), named_struct('kind', 2, 's', 1300, 'e', 1310))"
    text = "".join(chr(97 + i % 26) for i in range(3000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").select(F.struct("doc_id", "text").alias("row_"), F.expr(spans).alias("spans_"))
    (row,) = pii._replaced(df, ["doc_id", "text"]).collect()
    assert row["text"] == text[:2] + "<EMAIL><PHONE>" + text[1201:1300] + "<CARD>" + text[1310:]


# -- quality, mix, packing


def test_quality_verdict_against_plain_python(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("the of and to in river stone house walk green".split()) for _ in range(40)) for _ in range(60)]
    bad = [" ".join("###BUY" + "$" * 3 + "!" for _ in range(30)) for _ in range(15)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    feats = quality.features(df)
    model = quality.fit(feats)
    names = [f"v{i}" for i in range(len(quality.votes()))]
    rows = quality.judged(feats, model).select("*", *(v.alias(k) for v, k in zip(quality.votes(), names, strict=True))).collect()
    again = weak.fit(list(Counter(tuple(r[k] for k in names) for r in rows).items()), len(names), prior=0.8, start=(0.95, 0.35))
    for r in rows:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and again.posterior([r[k] for k in names]) >= 0.5)
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == {r["doc_id"] for r in rows if not r["base_failed"] and r["doc_id"] < 60}


def test_targets_against_stepwise_resharing(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 9):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 5000]) for i in range(n)} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in mix.targets(df).collect()}
        order = sorted((s for s in sizes if s is not None)) + [None]
        w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
        target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
        left = 1.5 * sum(sizes.values())
        while left > 1e-9 and open_:
            share, total = left, sum(w[s] for s in open_)
            left = 0.0
            for s in list(open_):
                target[s] += share * w[s] / total
                if target[s] >= 2 * sizes[s]:
                    left += target[s] - 2 * sizes[s]
                    target[s] = 2.0 * sizes[s]
                    open_.discard(s)
        assert all(math.isclose(got[s], target[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_boundary_ranges_are_small_for_any_weight(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET", 50)
    monkeypatch.setattr(mix, "BINS", 16)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source"), F.when(F.col("id") % 2 == 0, "a b c").otherwise("### 111 $$$").alias("text"))
    slim = mix.cut(mix.measured(df).select("doc_id", "source", "size", "key_"), "t")
    ranges = mix._boundaries(slim, spark.createDataFrame([("s0", 3001), ("s1", 4)], "source string, rest long")).collect()
    assert len(ranges) == 2 and all(0 < r["n"] <= 50 for r in ranges)
    for r in ranges:
        keys = sorted((x["key_"], x["size"]) for x in slim.where(F.col("source") == r["source"]).collect())
        before = sum(s for k, s in keys if k < r["low"])
        assert before == r["start_"] <= r["rest"] < before + sum(s for k, s in keys if r["low"] <= k <= r["high"])


def test_packing_against_all_partitions():
    """Small cases: never worse than the cheapest of all ways to share the pieces out by a tenth, and no bin is larger than need be."""

    def parts(items):
        if not items:
            yield []
            return
        first, rest = items[0], items[1:]
        for p in parts(rest):
            yield [[first], *p]
            for i in range(len(p)):
                yield [*p[:i], [first, *p[i]], *p[i + 1 :]]

    rng = random.Random(5)
    for _ in range(25):
        sizes = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 7))), reverse=True)
        _, _, final = packing.pack(sizes, (4, 8, 16), 1)
        best = min(sum(next(x for x in (4, 8, 16) if x >= sum(b)) + 1 for b in p) for p in parts(sizes) if all(sum(b) <= 16 for b in p))
        assert best <= sum(final) + len(final) <= 1.34 * best


# -- toxicity


def test_window_lengths_against_plain_compression():
    m = toxicity.train(["you scum idiot fool " * 5 + str(i) for i in range(40)] + ["green river stone walk " * 5 + str(i) for i in range(40)], [1] * 40 + [0] * 40)
    how = zstd.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=8, min_match=5, target_length=64, strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    text = "You scum, idiot of a green river! " * 10 + "y" * 500
    for w, (o, t) in zip(toxicity.windows(text), map(m.lengths, toxicity.windows(text)), strict=True):
        for tail, n in ((b" " * len(m.toxic), o), (m.toxic, t)):
            d = zstd.ZstdCompressionDict(m.ordinary + tail, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            packed = zstd.ZstdCompressor(dict_data=d, compression_params=how).compress(w)
            assert len(packed) == n and zstd.ZstdDecompressor(dict_data=d, format=zstd.FORMAT_ZSTD1_MAGICLESS).decompress(packed, max_output_size=len(w)) == w
    words = [w for x in toxicity.windows(text) for w in x.split()]
    assert words == toxicity._words(text) and all(len(w) <= toxicity.LONGEST_WORD for w in words)


def test_toxic_stems_inside_words():
    rng = random.Random(0)
    syllables = ["an", "er", "lich", "keit", "ung", "be", "ge", "ver", "sch", "ein"]
    word = lambda stem="": stem + "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda bad: " ".join(word("drulzo" if bad and rng.random() < 0.08 else "") for _ in range(80))
    m = toxicity.train([text(0) for _ in range(150)] + [text(1) for _ in range(60)], [0] * 150 + [1] * 60)
    fresh = [(text(y), y) for y in (0, 1) for _ in range(60)]
    assert toxicity._apart(np.array([m.score(t) for t, _ in fresh]), np.array([y for _, y in fresh])) > 0.95


def test_sample_is_bounded_and_the_same_again(spark):
    docs = spark.range(3000).select((F.col("id") % 1000).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    one, counts = toxicity.sample(docs, labels, toxic=20)
    assert counts == {0: 900, 1: 100} and one == toxicity.sample(docs.repartition(7), labels.repartition(3), toxic=20)[0] and len(one) <= 160
