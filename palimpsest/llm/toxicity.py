"""Toxicity by compression distance: windows of a text are compressed with a toxic and an ordinary zstandard dictionary.

Both dictionaries are trained with ``zstandard.train_dictionary``: the ordinary one on words of ordinary documents, the toxic one
on those words of toxic documents that hold a telling 6-mer, one that the class's documents use significantly more often (6-mers
of bytes are what the trainer itself ranks text by, so stems inside longer words count too). As most of a toxic text is ordinary,
its windows are compressed with the toxic dictionary behind the ordinary one, and the ordinary length is measured with blanks in
its place: lengths differ only by what was learned from the toxic class. A window's gain is its ordinary less its toxic length.

Two thresholds are calibrated: how telling a 6-mer must be, and the gain from which a window counts. The halves of the sample are
scored by each other's dictionaries, and the pair that tells the classes apart best is taken. The share and the number of windows
that count and the mean gain then give a probability by logistic regression.

The classifier is fitted on a bounded sample of labelled rows, chosen by hash: about ``SAMPLE`` toxic and three times as many
ordinary documents, of at most ``MAX_CHARS`` code points. Every text is scored whole, window after window.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..tables import table

SAMPLE, ORDINARY_A_TOXIC, MAX_CHARS = 1200, 3, 20_000
#: Words of a window, and bytes from which a word is cut in pieces.
WINDOW, LONGEST_WORD = 12, 64
MER = 6
#: What a 6-mer's z-score must reach, to choose from, and gains of a window.
TELLING, GAINS = (4.0, 5.0, 6.0, 8.0), (1, 2, 3, 4)
FEWEST = 24
TOXIC_BYTES, ORDINARY_BYTES = 1024, 60_000
#: Documents of each half that calibrate, by class.
CALIBRATE = (150, 450)
PREDICT_AT = 0.3
#: The first repeat offsets, which end a dictionary's entropy tables; fixed by the format.
_CONTENT = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])
_STRIP = b".,;:!?\"'()[]{}|#*$%&<>"


def _words(text: str | None) -> list[bytes]:
    """Lower-case words without marks around them; long runs in pieces."""
    out = []
    for w in (text or "").lower().encode("utf-8", "surrogatepass").split():
        w = w.strip(_STRIP)
        if len(w) <= LONGEST_WORD:
            if w:
                out.append(w)
        else:
            out += [w[i : i + LONGEST_WORD] for i in range(0, len(w), LONGEST_WORD)]
    return out


def windows(text: str | None) -> list[bytes]:
    ws = _words(text)
    return [b" %b " % b" ".join(ws[i : i + WINDOW]) for i in range(0, len(ws), WINDOW)]


class Model:
    """Two dictionaries, a gain threshold and four coefficients; small, so it goes to the tasks with the function that uses it."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: int = 2, coef: tuple[float, ...] = (0.0,) * 4):
        self.toxic, self.ordinary, self.threshold, self.coef = toxic, ordinary, threshold, coef
        self._pair = None

    def __getstate__(self):
        return self.__dict__ | {"_pair": None}

    def lengths(self, window: bytes) -> tuple[int, int]:
        """Compressed length of a window without and with what was learned from the toxic class."""
        if self._pair is None:
            how = zstd.ZstdCompressionParameters(window_log=17, chain_log=17, hash_log=17, search_log=8, min_match=5, target_length=64, strategy=zstd.STRATEGY_GREEDY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstd.FORMAT_ZSTD1_MAGICLESS)
            behind = (b" " * len(self.toxic), self.toxic)
            self._pair = [zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(self.ordinary + d, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how).compress for d in behind]
        o, t = self._pair
        return len(o(window)), len(t(window))

    def gains(self, text: str | None) -> np.ndarray:
        return np.array([o - t for o, t in map(self.lengths, windows(text))] or [0])

    def features(self, g: np.ndarray) -> np.ndarray:
        n = (g >= self.threshold).sum()
        return np.array([1.0, 10 * n / max(len(g), 3), math.log1p(n), float(np.clip(g.mean(), -3, 3))])

    def score(self, text: str | None) -> float:
        v = float(self.features(self.gains(text)) @ np.array(self.coef))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))


def _start(text: str) -> bytes:
    """What near copies of a text share."""
    return b" ".join(_words(text[:200]))[:32]


def _mers(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """6-mers within words and their ends, as numbers, with the number of beginnings of texts they occur under; near copies count once."""
    starts = {x: i for i, x in enumerate(dict.fromkeys(map(_start, texts)))}
    parts = [b"".join(b" %b " % w for w in sorted(set(_words(t)))) for t in texts]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    n = len(raw) - MER + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), len(starts)
    doc = np.repeat(np.array([starts[_start(t)] for t in texts], np.uint64), [len(p) for p in parts])
    mer, inner = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(MER):
        mer = mer << np.uint64(8) | raw[k : n + k]
        if 0 < k < MER - 1:
            inner |= raw[k : n + k] == 32
    ok = ~inner
    pairs = np.sort(mer[ok] << np.uint64(16) | doc[:n][ok])
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    found, counts = np.unique(pairs >> np.uint64(16), return_counts=True)
    return found, counts, len(starts)


def telling(toxic: list[str], ordinary: list[str]) -> dict[bytes, float]:
    """z-score of the log-ratio of document frequencies of each 6-mer of the toxic texts, from the least of ``TELLING`` on.

    Few texts can't give such scores; where none reaches it, those near the greatest are taken.
    """
    a, in_a, n_a = _mers(toxic)
    b, in_b, n_b = _mers(ordinary)
    other = np.zeros(len(a))
    if len(b):
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        other = np.where(b[at] == a, in_b[at], 0)
    x, y = in_a + 0.5, other + 0.5 * (n_b + 1) / (n_a + 1)
    z = (np.log(x / (n_a + 1)) - np.log(y / (n_b + 1))) / np.sqrt(1 / x + 1 / y)
    keep = z >= min(*TELLING, 0.8 * z.max(initial=0.0))
    keep &= z > 0
    return {int(m).to_bytes(MER, "big"): float(s) for m, s in zip(a[keep], z[keep], strict=True)}


def _trained(words: list[bytes], size: int, k: int) -> bytes:
    """The last ``size`` bytes of the content of a dictionary trained on the words; the words joined, where they are too few to train on."""
    if len(words) >= 64:
        for n in (size, size // 2, size // 4):
            try:
                got = zstd.train_dictionary(n, [b"".join(words[i : i + 8]) for i in range(0, len(words), 8)], k=k, d=MER).as_bytes()
                return got.partition(_CONTENT)[2][-size:].rjust(size)
            except zstd.ZstdError:  # too little text for this size
                continue
    return b"".join(dict.fromkeys(words))[:size].rjust(size)


def toxic_words(texts: list[str], mers: set[bytes]) -> list[bytes]:
    """Words with one of the 6-mers, each as often as it occurs."""
    known: dict[bytes, bool] = {}
    out = []
    for t in texts:
        for w in _words(t):
            if w not in known:
                x = b" %b " % w
                known[w] = any(x[i : i + MER] in mers for i in range(len(x) - MER + 1))
            if known[w]:
                out.append(b" %b " % w)
    return out


def dictionaries(toxic: list[str], ordinary: list[str], z: dict[bytes, float], least: float, base: bytes | None = None) -> tuple[bytes, bytes]:
    """(toxic, ordinary) for one threshold, which ``FEWEST`` 6-mers pass in any case; ``base`` is the ordinary one if it is there already."""
    if base is None:
        base = _trained([b" %b " % w for t in ordinary[:: max(1, len(ordinary) // 800)] for w in _words(t)], ORDINARY_BYTES, 16)
    ranked = sorted(z, key=lambda m: (-z[m], m))
    own = toxic_words(toxic, set(ranked[: max(FEWEST, sum(s >= least for s in z.values()))]))
    return (_trained(own, TOXIC_BYTES, 24) if own else b" " * TOXIC_BYTES), base


def _apart(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve."""
    n1 = y.sum()
    return float((pd.Series(score).rank().to_numpy()[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * (len(y) - n1)))


def train(texts: Iterable[str | None], labels: Iterable[int]) -> Model:
    """Without both classes the model scores every text with the share of toxic rows. Copies of a text count once."""
    pairs = sorted({(t or "", int(y)) for t, y in zip(texts, labels, strict=True)})
    sides = [[t for t, y in pairs if y == k] for k in (1, 0)]
    if not all(sides):
        share = min(0.99, max(0.01, len(sides[0]) / max(1, len(pairs))))
        return Model(b" " * 16, b" " * 16, 2, (math.log(share / (1 - share)), 0.0, 0.0, 0.0))
    half = {t: zlib.crc32(_start(t)) % 2 for t, _ in pairs}  # near copies lie in one half
    halves = [[[t for t in side if half[t] == h] or side for side in sides] for h in (0, 1)]
    scored: dict[float, list[np.ndarray]] = {z: [] for z in TELLING}
    ys: list[int] = []
    for h in (0, 1):
        learn, test = halves[1 - h], [side[:n] for side, n in zip(halves[h], CALIBRATE, strict=True)]
        z, base = telling(*learn), None
        ys += [1] * len(test[0]) + [0] * len(test[1])
        for least in TELLING:
            d, base = dictionaries(*learn, z, least, base)
            m = Model(d, base)
            scored[least] += [m.gains(t) for side in test for t in side]
    y = np.array(ys)

    def area(least: float, gain: int) -> float:
        return _apart(np.array([(g >= gain).sum() / max(len(g), 3) + 0.01 * g.mean() for g in scored[least]]), y)

    least, gain = max(((z, g) for z in TELLING for g in GAINS), key=lambda x: area(*x))
    model = Model(*dictionaries(*sides, telling(*sides), least), gain)
    x = np.array([model.features(g) for g in scored[least]])
    w = np.zeros(4)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ w).sum() - y @ (x @ w) + 0.05 * w @ w)

    for _ in range(50):  # Newton's method with a small ridge; steps are halved until they improve
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), x.T @ (y - p) - 0.1 * w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w + step
    # the texts that calibrate hold the classes in other shares than the sample: shift the intercept back
    n1, n0 = int(y.sum()), int((1 - y).sum())
    w[0] += math.log(len(sides[0]) / len(sides[1])) - math.log(n1 / n0)
    model.coef = tuple(float(v) for v in w)
    return model


def sample(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE, max_chars: int = MAX_CHARS) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """Labelled texts for training, about ``toxic`` toxic and ``ORDINARY_A_TOXIC`` times as many ordinary ones, and the rows of each class.

    They are the rows with the smallest hashes of doc_id, so reruns agree, and never more than twice as many.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic")
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts:
        return [], {}
    sizes = {1: toxic, 0: toxic * ORDINARY_A_TOXIC}
    spot = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000))
    share = F.lit(0)
    for y, n in counts.items():
        share = F.when(F.col("toxic") == y, F.lit(min(1_000_000, math.ceil(1_000_000 * sizes[y] / n)))).otherwise(share)
    most = 2 * sum(sizes.values())
    chosen = known.withColumn("spot_", spot).where(F.col("spot_") < share).orderBy("spot_", "doc_id", "toxic").limit(most)
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text")
    got = texts.join(F.broadcast(chosen), "doc_id").orderBy("spot_", "doc_id", "toxic", "text").limit(most).select("text", "toxic").collect()
    return [(r["text"], r["toxic"]) for r in got], counts


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    pairs, counts = sample(docs, labels)
    model = train([t for t, _ in pairs], [y for _, y in pairs])
    # the sample holds the classes in other shares than the corpus: shift the intercept back
    n1, n0 = (sum(y == k for _, y in pairs) for k in (1, 0))
    if n1 and n0:
        shift = math.log(counts[1] / counts[0]) - math.log(n1 / n0)
        model.coef = (model.coef[0] + shift, *model.coef[1:])
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``; map-only. Null and empty texts are scored as a text without windows; repeated rows score alike."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return docs.withColumn("score", score(F.col(text_col)))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~fold)
    out = scored(docs, fitted(docs, labels))
    return out.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
