"""Language identification by a linear-chain conditional random field over a text's words.

A word's features are its character 2-, 3- and 4-grams with marked ends (which hold its affixes), hashed, and its entry in a
lexicon of frequent words; transitions between labels are learned with them. Forward-backward gives every word's label
probabilities, also in code-switched text, and a text's language is the one with most expected words.

Everything runs in numpy over batches of whole texts: n-gram weights are looked up for all characters at once, and
forward-backward works on all chunks of ``CHUNK`` words at once - first each chunk's transfer matrix, then the messages from chunk
to chunk, then the words within chunks - which is exact. The field is fitted on a sample: about ``SAMPLE`` different texts of every
language, of each its first ``MAX_CHARS`` code points, chosen by hash. Memory grows with the square of the number of languages.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table

SAMPLE, MAX_CHARS = 80, 20_000
ROWS = 1 << 16
LEXICON = 400
CHUNK = 32
BATCH_CHARS = 600_000
ROUNDS = 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case, and whether it is a letter."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if c.isupper() and len(x := c.lower()) == 1:
                lower[i] = ord(x)
    return lower, letter


class Words:
    """Words (runs of letters) of some texts: n-gram rows, word hashes and the texts' word counts."""

    def __init__(self, texts: list[str]):
        lower, letter = _tables()
        raw = np.frombuffer((" \0\0 " + "\n".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = letter[raw]
        c = np.where(ok, lower[raw], 0).astype(np.uint32)
        edge = np.diff(ok.astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        firsts = 4 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.bounds = np.searchsorted(self.start, firsts)
        # windows that end at each letter or at the blank after a word
        at = np.flatnonzero(ok | np.r_[False, ok[:-1]])
        c0, c1, c2, c3 = c[at], c[at - 1], c[at - 2], c[at - 3]
        k = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263, 374761393)]
        h2 = c0 * k[0] + c1 * k[1]
        h3 = h2 + c2 * k[2]
        h4 = h3 + c3 * k[3]
        first, second = c1 == 0, c2 == 0
        rows = []
        for n, (h, bad) in enumerate(((h2, None), (h3, first), (h4, first | second))):
            h = (h ^ (h >> np.uint32(15))) * k[4]
            i = np.maximum((h >> np.uint32(16)).astype(np.int32), 1)
            if bad is not None:
                i[bad] = 0  # row 0 is never taught: no such window
            rows.append(i + n * ROWS)
        self.rows = rows
        self.first = np.searchsorted(at, self.start)
        place = at - np.repeat(self.start, np.diff(np.r_[self.first, len(at)])) if len(self.start) else at
        power = np.cumprod(np.full(64, 6364136223846793005, np.uint64))
        terms = (c0.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, 63)]
        self.hash = np.add.reduceat(terms, self.first) if len(self.start) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)


class Field:
    """Labels, n-gram weights (3 * ROWS, labels), lexicon and transitions."""

    def __init__(self, labels: list[str]):
        k = len(labels)
        self.labels = labels
        self.weights = np.zeros((3 * ROWS, k), np.float32)
        self.lex_hash = np.zeros(1, np.uint64)
        self.lex = np.zeros((2, k), np.float32)  # the last row is for words outside
        self.trans = np.eye(k) * 2.0

    def lex_rows(self, w: Words) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.lex_hash, w.hash), len(self.lex_hash) - 1)
        return np.where(self.lex_hash[i] == w.hash, i, len(self.lex) - 1)

    def emissions(self, w: Words) -> np.ndarray:
        g = self.weights[w.rows[0]]
        g += self.weights[w.rows[1]]
        g += self.weights[w.rows[2]]
        return np.add.reduceat(g, w.first, axis=0) + self.lex[self.lex_rows(w)]

    def marginals(self, e: np.ndarray, bounds: np.ndarray, pairs: bool = False):
        """Label probabilities of every word; with ``pairs`` also the expected transitions. ``bounds``: first word of each text, and the end."""
        k = e.shape[1]
        sizes = np.diff(bounds)
        chunks = -(-sizes // CHUNK)
        n = int(chunks.sum())
        doc = np.repeat(np.arange(len(sizes)), chunks)
        nth = np.arange(n) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        base = bounds[:-1][doc] + nth * CHUNK
        idx = base + np.arange(CHUNK)[:, None]
        real = idx < bounds[1:][doc]
        short = [np.flatnonzero(~r) for r in real]  # chunks that end before word t
        idx = np.where(real, idx, base)
        # (label, word of the chunk, chunk); chunks are short enough that doubles need no scaling within one
        psi = np.exp(e - e.max(1, keepdims=True)).T.astype(np.float64)[:, idx]
        a = np.exp(self.trans - self.trans.max())
        m = np.broadcast_to(np.eye(k)[:, :, None], (k, k, n)).copy()  # (to, from, chunk)
        for t in range(CHUNK):
            step = (a.T @ m.reshape(k, -1)).reshape(k, k, n)
            step *= psi[:, t, None, :]
            if len(short[t]):
                step[:, :, short[t]] = m[:, :, short[t]]
            m = step
        firsts = np.cumsum(chunks) - chunks
        into, outof = np.full((k, n), 1 / k), np.full((k, n), 1 / k)
        live = np.flatnonzero(chunks > 1)
        for j in range(1, int(chunks.max(initial=0))):
            live = live[chunks[live] > j]
            c = firsts[live] + j
            v = np.einsum("fn,tfn->tn", into[:, c - 1], m[:, :, c - 1])
            into[:, c] = v / v.sum(0)
        live = np.flatnonzero(chunks > 1)
        for j in range(1, int(chunks.max(initial=0))):
            live = live[chunks[live] > j]
            c = firsts[live] + chunks[live] - 1 - j
            v = np.einsum("tn,tfn->fn", outof[:, c + 1], m[:, :, c + 1])
            outof[:, c] = v / v.sum(0)
        alpha = np.empty((CHUNK + 1, k, n))
        alpha[0] = into
        for t in range(CHUNK):
            np.matmul(a.T, alpha[t], out=alpha[t + 1])
            alpha[t + 1] *= psi[:, t]
        beta, expected = outof, np.zeros((k, k))
        post = np.empty((CHUNK, n, k))
        for t in range(CHUNK - 1, -1, -1):
            p = alpha[t + 1] * beta
            p /= p.sum(0)
            post[t] = p.T
            pb = psi[:, t] * beta
            if pairs:
                use = real[t] & ~((nth == 0) & (t == 0))
                x = alpha[t][:, None, use] * a[:, :, None] * pb[None, :, use]
                expected += (x / x.sum((0, 1))).sum(2)
            step = a @ pb
            if len(short[t]):
                step[:, short[t]] = beta[:, short[t]]
            beta = step
        out = np.empty((len(e), k))
        out[idx[real]] = post[real]
        return (out, expected) if pairs else out

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray, Words, np.ndarray]:
        """(language, score) of each text, with the words and their label probabilities."""
        w = Words(texts)
        if not len(w) or not self.labels:
            return ["und"] * len(texts), np.zeros(len(texts)), w, np.zeros((0, len(self.labels)))
        post = self.marginals(self.emissions(w), w.bounds)
        sums = np.diff(np.r_[np.zeros((1, post.shape[1])), np.cumsum(post, 0)][w.bounds], axis=0)
        n = np.diff(w.bounds)
        best = sums.argmax(1)
        score = np.clip(sums[np.arange(len(n)), best] / np.maximum(n, 1), 0, 1)
        return [self.labels[b] if x else "und" for b, x in zip(best, n, strict=True)], np.where(n > 0, score, 0.0), w, post


def train(texts: list[str], langs: list[str], rounds: int = ROUNDS) -> Field:
    """Maximises the conditional likelihood (Adam, with a small penalty); all words of a text carry its language."""
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    texts, langs = [texts[i] for i in order], [langs[i] for i in order]
    f = Field(sorted(set(langs)))
    w = Words(texts)
    if not len(w) or len(f.labels) < 2:
        return f
    k = len(f.labels)
    y_doc = np.array([f.labels.index(x) for x in langs])
    sizes = np.diff(w.bounds)
    y = np.repeat(y_doc, sizes)
    lex: set[int] = set()
    for j in range(k):
        lex.update(h for h, _ in sorted(Counter(w.hash[y == j].tolist()).items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    f.lex_hash = np.array(sorted(lex), np.uint64)
    f.lex = np.zeros((len(f.lex_hash) + 1, k), np.float32)
    rows = np.concatenate(w.rows)
    used, rows_in = np.unique(rows, return_inverse=True)
    rows_in = rows_in.reshape(3, -1)
    counts = np.diff(np.r_[w.first, len(w.rows[0])])
    word_of = np.repeat(np.arange(len(w)), counts)
    lex_rows = f.lex_rows(w)
    hot = np.eye(k)[y]
    nth = np.ones(len(w), bool)
    nth[w.bounds[:-1][sizes > 0]] = False
    seen = np.zeros((k, k))
    np.add.at(seen, (y[:-1][nth[1:]], y[1:][nth[1:]]), 1)
    params = [np.zeros((len(used), k)), np.zeros(f.lex.shape), f.trans.copy()]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    zero = np.isin(used % ROWS, [0])
    for step in range(1, rounds + 1):
        g = params[0][rows_in[0]] + params[0][rows_in[1]] + params[0][rows_in[2]]
        e = np.add.reduceat(g, w.first, axis=0) + params[1][lex_rows]
        f.trans = params[2]
        post, expected = f.marginals(e, w.bounds, pairs=True)
        d = (hot - post) / len(w)
        per_row = d[word_of]
        grad0 = np.stack([np.bincount(rows_in.ravel(), np.tile(per_row[:, j], 3), len(used)) for j in range(k)], 1) - 1e-6 * params[0]
        grad1 = np.stack([np.bincount(lex_rows, d[:, j], len(f.lex)) for j in range(k)], 1) - 1e-6 * params[1]
        grad2 = (seen - expected) / len(w) - 1e-4 * params[2]
        grad0[zero] = 0
        for i, gr in enumerate((grad0, grad1, grad2)):
            m, v = moments[i]
            m += 0.1 * (gr - m)
            v += 0.01 * (gr * gr - v)
            params[i] = params[i] + (0.1 if i < 2 else 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    f.weights[used] = params[0]
    f.lex = params[1].astype(np.float32)
    f.trans = params[2]
    return f


def sample(docs: DataFrame, per_lang: int = SAMPLE, max_chars: int = MAX_CHARS) -> tuple[list[str], list[str]]:
    """About ``per_lang`` texts of each language (half as many at least, or all), chosen by hash of the text; copies of a text count once, and of longer texts the first ``max_chars`` code points are taken."""
    known = docs.where("lang is not null and text is not null").select(F.substring("text", 1, max_chars).alias("text"), "lang")
    known = known.withColumn("hash_", F.xxhash64(F.lit("sample"), "text"))
    counts = {r["lang"]: r["count"] for r in known.select("lang", "hash_").distinct().groupBy("lang").count().collect()}
    whole, times, texts, langs = 10**12, 1, [], []
    while counts:
        shares = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(whole, math.ceil(whole * per_lang * times / n)))))
        got: dict[str, list[str]] = {lang: [] for lang in counts}
        for r in known.where(F.pmod("hash_", F.lit(whole)) < shares[F.col("lang")]).select("text", "lang").distinct().collect():
            got[r["lang"]].append(r["text"])
        for lang, own in got.items():
            if len(own) >= min(per_lang // 2, counts[lang]):
                texts += own
                langs += [lang] * len(own)
                del counts[lang]
        times *= 2  # hardly ever needed
    return texts, langs


def _parts(texts: list[str], labels: int) -> Iterator[tuple[int, int]]:
    """Batches of whole texts, smaller where there are many labels: a chunk takes a matrix of labels by labels."""
    most = BATCH_CHARS // max(1, (labels // 8) ** 2)
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= most):
            n += len(texts[end])
            end += 1
        yield at, end
        at = end


def labelled(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with lang_pred and score. Null texts and texts without letters are ``und`` with score 0; repeated rows get equal results."""
    rest = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    slim = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names, scores = batch.column("text_").to_pylist(), [], []
            for at, end in _parts(texts, len(field.labels)):
                n, s, _, _ = field.label(texts[at:end])
                names += n
                scores += s.tolist()
            yield pa.record_batch({c: batch.column(c) for c in rest} | {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text_"), "lang_pred string, score double"])
    return slim.mapInArrow(run, schema)


def op3_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    field = train(*sample(docs.where(~held_out).select("text", "lang")))
    return labelled(docs.select("doc_id", "text"), field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_langid": op3_langid}
ORACLE_SQL: dict[str, str] = {}
