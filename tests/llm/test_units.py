import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from palimpsest.llm import html_text, langid, licenses, packing, pjpeg, simhash, toxicity, weak


def test_fingerprint_against_plain_python():
    def plain(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        if not w:
            return 0
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", " \n", "One", "one Two", "A b c", "É é ñ x A b c d A b c", "a " * 50):
        assert simhash.fingerprint(t) == plain(t)
    assert simhash.fingerprint(None) == 0


def test_ring_keys_miss_no_pair():
    rng, keys = random.Random(3), simhash.ring_keys()
    for _ in range(3000):
        x = rng.getrandbits(64)
        for d in (0, 1, 2, 3):
            y = x ^ sum(1 << b for b in rng.sample(range(64), d))
            shared = [(s, m) for s, m in keys if x & m == y & m]
            assert any(len(simhash.link_sorted(np.zeros(2), np.array([s, s]), np.array([x, y], np.uint64))[0]) for s, m in shared)
            assert all(any((x ^ y) & q == 0 for q in simhash.quarters(m)) for _, m in shared)


def test_weak_supervision_finds_the_classes():
    rng = random.Random(1)
    rows = []
    for _ in range(4000):
        y = rng.random() < 0.8
        rows.append((tuple((y if rng.random() < a else not y) * 1 if rng.random() < 0.9 else -1 for a in (0.95, 0.8, 0.7, 0.9)), y))
    m = weak.fit(list(Counter(v for v, _ in rows).items()), 4, prior=0.6)
    assert sum((m.posterior(list(v)) >= 0.5) == y for v, y in rows) / len(rows) > 0.93 and abs(m.prior - 0.8) < 0.05
    assert weak.fit([], 2).posterior([1, -1]) > 0.5


@pytest.mark.parametrize("seed", range(5))
def test_packing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 4096) for _ in range(300)), reverse=True)
    bins, starts, final = packing.pack(sizes)
    held = Counter()
    for s, b, at in zip(sizes, bins, starts, strict=True):
        assert at == held[b]
        held[b] += s
    assert all(held[b] <= final[b] and final[b] in packing.LENGTHS and all(x < held[b] for x in packing.LENGTHS if x < final[b]) for b in held)
    assert sum(final) < 1.25 * sum(sizes)
    assert packing.pack([3])[2] == [512] and packing.pack([]) == ([], [], [])


def test_license_scan():
    for t in licenses.templates():
        text = " ".join(t.words)
        assert t.name in [x[0] for x in licenses.scan(f"some words\n{text}\nand more")]
        assert any(c in text for c in licenses.cues())
    text = "é x. Licensed under the Apache License, Version 2.0. y Released under the MIT License."
    assert [(n, text[s:e]) for n, _, s, e in licenses.scan(text)] == [("Apache-2.0", "Licensed under the Apache License, Version 2.0"), ("MIT", "Released under the MIT License")]
    assert licenses.scan(None) == [] == licenses.scan("the license of the version")
    a, b = list("xabcdyefgz"), list("abcdqefg")
    assert [a[i] for i, _ in licenses.patience(a, b)] == list("abcdefg")


@pytest.mark.parametrize("nth", range(len(licenses.TEXTS)))
def test_license_scan_of_joined_notices(nth):
    name, t, *_ = licenses.TEXTS[nth]
    for gap in (" ", " x ", " x y "):
        for times in (2, 3, 5):
            found = licenses.scan(gap.join([t] * times))
            assert [x[0] for x in found] == [name] * times and all(x[1] == 1 for x in found), (gap, found)


PAGE = """<html><head><title>t</title><script>var a="</p><p>no</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>
<div class="ad">Buy now, cheap, cheap</div><article><h1>Head &amp; more</h1><p>First   paragraph,
with <b>bold</b> &eacute;.<p>Second<br>one<ul><li>item one<li>item two</ul></article><div id="comments"><p>Nice, post, really, good</p></div><form><p>search</p></form><footer>end</footer>"""


def test_html():
    assert html_text.extract(PAGE) == "Head & more\nFirst paragraph, with bold é.\nSecond one\nitem one\nitem two"
    assert html_text.extract(None) == "" == html_text.extract("") == html_text.extract("<div></div>")
    assert html_text.extract("just text") == "just text"
    assert html_text.extract("<div>" * 5000 + "deep") == "deep"
    assert html_text.extract("<p>a <b c=") == "a"


def test_html_keeps_all_of_an_article():
    p = "word, " * 5 + "x" * 270
    many, few = f"<p>{p}</p>" * 60, f"<p>{p}</p>" * 5
    for page in (f"<article><h1>h</h1><section>{many}</section><section>{few}</section><ul><li>i</ul><p>short</p></article>", f"<body><div><h1>h</h1><div>{many}</div><div>{few}</div><div><ul><li>i</ul></div><div><span>short</span></div></div></body>"):
        assert html_text.extract(page) == "\n".join(["h", *[p] * 65, "i", "short"])
    assert html_text.extract(f"<body><div><article>{many}</article></div><main><p>{p}</p></main></body>") == "\n".join([p] * 61)
    assert html_text.extract(f"<article><p>teaser</p></article><div><div>{many}</div></div><div><div>{few}</div></div>") == "\n".join(["teaser", *[p] * 65])


def test_html_wrappers_named_like_boilerplate():
    p = f"<p>{'word, ' * 5 + 'x' * 270}</p>"
    text, ad = p[3:-4], '<div class="ad">Buy, now</div>'
    for page in (f'<div class="content-sidebar-wrap"><main>{p}</main>{ad}</div>', f'<div class="content has-sidebar"><article>{p}</article>{ad}</div>', f'<div id="page" class="no-banner">{p}{ad}</div>', f'<div class="header-layout"><article>{p}</article></div>'):
        assert html_text.extract(f"<html><body>{page}</body></html>") == text
    assert html_text.extract(f'<article>{p}</article><div class="related">{p[:99]}</p></div>{ad}') == text


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    f = langid.Field(["a", "b", "c"])
    f.trans = rng.normal(size=(3, 3))
    bounds = np.array([0, 70, 70, 71, 135])
    e = rng.normal(size=(135, 3)).astype(np.float32)
    got, want = f.marginals(e, bounds), []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        a, alpha, beta = np.exp(f.trans), [], np.ones(3)
        v = np.ones(3) / 3
        for t in range(lo, hi):
            v = (v @ a) * np.exp(e[t])
            alpha.append(v := v / v.sum())
        rows = []
        for t in range(hi - 1, lo - 1, -1):
            p = alpha[t - lo] * beta
            rows.append(p / p.sum())
            beta = a @ (np.exp(e[t]) * beta)
            beta /= beta.sum()
        want += rows[::-1]
    assert np.allclose(got, np.array(want), atol=1e-6)


def test_language_words_in_switched_text():
    en, fr = "the cat and the dog went to this house with that man", "le chat et les chiens vont dans cette maison avec un homme"
    f = langid.train([en] * 20 + [fr] * 20, ["en"] * 20 + ["fr"] * 20)
    names, score, w, post = f.label([en, fr, f"{en} {en} {fr}", "", "123 !"])
    assert names == ["en", "fr", "en", "und", "und"] and score[3] == 0
    third = post[w.bounds[2] : w.bounds[3]]
    assert third[0].argmax() == 0 and third[-1].argmax() == 1
    assert langid.Field([]).label(["x"])[0] == ["und"]


def test_toxicity_tells_classes_apart():
    rng = random.Random(0)
    text = lambda bad: " ".join(rng.choice(["river", "stone", "green", "walk", "house"] + ["scoundrel", "nitwit"] * bad) for _ in range(60))
    m = toxicity.train([text(0) for _ in range(100)] + [text(1) for _ in range(100)], [0] * 100 + [1] * 100)
    assert m.score(text(1)) > 0.9 > 0.1 > m.score(text(0))
    assert 0 <= m.score("") <= 1 and m.score(None) == m.score("") and math.isclose(toxicity.train([], []).score("x"), 0.01)


def test_jpeg_round_trip_by_both_readers(monkeypatch):
    rng = random.Random(2)
    data = [pjpeg.payload(rng.randbytes(n)) for n in (0, 1, 192, 193, 1000, 1000, 5000)] + [b"\xff" * 576]
    files = pjpeg.encode(data)
    for even in (True, False):
        if not even:
            monkeypatch.setattr(pjpeg, "_even_scan", lambda *a: False)
        else:
            monkeypatch.setattr(pjpeg, "read_scan", None)  # regular scans never need it
        for which, parsed in pjpeg.by_shape(files):
            coefs = pjpeg.coefficients(parsed)
            raw = pjpeg.stored_payload(parsed[0], coefs, max(len(data[i]) for i in which))
            assert all(r[: len(data[i])].tobytes() == data[i] for r, i in zip(raw, which, strict=True))
            assert pjpeg.rgb(parsed[0], coefs).shape == (len(which), parsed[0].height, parsed[0].width, 3)
        monkeypatch.undo()
    with pytest.raises(ValueError):
        pjpeg.parse(b"no")


def test_zigzag():
    assert pjpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and pjpeg.ZIGZAG[-2:].tolist() == [62, 63]
