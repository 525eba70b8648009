"""Personal data: regexes, gazetteers and context vote on candidate spans; EM weighs the voters and trains a span classifier.

All DataFrame expressions. Spans that pass the base rules are always reported. Other candidates (telephone numbers without a plus,
written-out addresses, social security numbers, IBANs, secrets) are reported where the final classifier says so and no base span
overlaps. The driver gets counts of vote patterns and shapes: at most 3 ** 7 * len(KINDS) * 4 of them.

Positions are code points, end exclusive. A text is split at its matches, so a match's start is the running sum of the lengths
before it; time follows the text's length and the number of matches. The patterns are possessive, which finds the same spans and
keeps Java's regex engine from recursing on long runs of digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from ..tables import table
from . import weak
from .scans import running

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
_KEY = "[A-Za-z0-9_/+-]"
#: After a failed start no later start in the same run of characters can match, so a start needs a new run or the last match's end.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = (rf"\x20?[\[({{]\x20?(?:{w}|{w.upper()})\x20?[\])}}]\x20?" for w in ("at", "dot"))
EXTRA = {
    "phone": r"(?<![0-9+)(.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])",
    "email": rf"(?<!{_LOCAL}){_LOCAL}++{_AT}[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # 15 to 34 characters by the standard
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?<![A-Za-z0-9_/+=-]){_KEY}{{24,}}+={{0,2}}+(?![A-Za-z0-9_/+=-])",
}
#: Words that announce personal data, and words that announce other numbers; lists of words, fixed.
CUES = "mail|email|e-mail|contact|courriel|correo|phone|tel|telephone|call|fax|mobile|telefon|téléphone|teléfono|card|visa|mastercard|carte|karte|tarjeta|ip|host|address|adresse|dirección|ssn|social|iban|account|konto|compte|cuenta|token|key|secret|password|passwort|apikey"
OTHER = "version|v|isbn|issn|page|seite|section|chapter|kapitel|figure|table|build|release|order|invoice|ticket"
#: Code points before a candidate that the context labeler sees; the longest word and what may follow it take 17.
CONTEXT = 32
# Gazetteers: public registries' entries, in part; lists, fixed.
TOP_DOMAINS = "com org net edu gov mil int info biz name io dev app ai co me tv xyz online site tech de fr es it nl be at ch uk ie pt pl cz sk hu ro bg gr se no dk fi is ru ua tr il us ca mx br ar cl pe ve za ng ke eg ma in pk cn jp kr tw hk sg my th vn id ph au nz eu"
NO_DOMAINS = "invalid local localhost test internal lan"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 233 234 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 387 420 421 502 503 504 505 506 507 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 975 976 977 992 993 994 995 996 998"
CARD_ISSUERS = "4 51 52 53 54 55 222 223 224 225 226 227 228 229 23 24 25 26 270 271 2720 34 37 300 301 302 303 304 305 36 38 39 6011 644 645 646 647 648 649 65 3528 3529 353 354 355 356 357 358 62"
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ ghs_ ghu_ github_pat_ glpat- sk- sk_live_ sk_test_ pk_live_ rk_live_ xoxb- xoxp- AIza ya29 eyJ SG npm_ pypi- dop_v1_ hf_ key- token-"
ACCEPT = 0.5


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))
    one = F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(one, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, "\\."), lambda p: p.cast("double") <= 255)


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    return {"email": F.lit(True), "ip": _octets(m), "card": F.when(_between(n, 13, 19), _luhn(m)).otherwise(False), "phone": _between(n, 9, 15)}[kind]


def _mod97(c: Column) -> Column:
    """The check of an IBAN: its country and check digits at the end, letters as 10 to 35."""
    x = F.replace(c, F.lit(" "), F.lit(""))
    each = F.split(F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4))), "")
    return F.aggregate(each, F.lit(0), lambda acc, d: F.when(d.rlike("[A-Z]"), (acc * 100 + F.ascii(d) - 55) % 97).when(d.rlike("[0-9]"), (acc * 10 + F.ascii(d) - 48) % 97).otherwise(acc)) == 1


def _any_of(names: str, before: str = "^(?:", after: str = ")") -> str:
    return before + "|".join(w.replace(".", "\\.") for w in sorted(names.split(), key=len, reverse=True)) + after


def _hits(t: Column, pattern: str, when: Column) -> Column:
    return F.when(when, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _none() -> Column:
    return F.array().cast("array<struct<s:int,e:int,m:string,pre:string,post:string>>")


def matches(df: DataFrame, t: Column, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with, for each name, an array of (s, e, m, pre, post): the matches of a pattern where its condition holds, else empty."""
    names = list(patterns)
    df = df.withColumns({f"{k}_hits": _hits(t, p, when) for k, (p, when) in patterns.items()})
    df = df.withColumns({f"{k}_gaps": F.when(F.size(f"{k}_hits") > 0, F.split(t, p)) for k, (p, _) in patterns.items()})
    df = running(df, {f"{k}_ends": F.when(F.size(f"{k}_hits") > 0, F.zip_with(f"{k}_hits", F.slice(F.col(f"{k}_gaps"), F.lit(1), F.size(f"{k}_hits")), lambda m, g: F.length(g) + F.length(m))) for k in names})

    def spans(k: str) -> Column:
        gaps, n = F.col(f"{k}_gaps"), F.size(f"{k}_hits")
        before, after = F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n)
        ends = F.zip_with(f"{k}_hits", f"{k}_ends", lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
        around = F.zip_with(before, after, lambda g, h: F.struct(F.right(g, F.lit(CONTEXT)).alias("pre"), F.left(h, F.lit(1)).alias("post")))
        return F.when(n > 0, F.zip_with(ends, around, lambda x, g: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), g["pre"].alias("pre"), g["post"].alias("post")))).otherwise(_none())

    return df.withColumns({k: spans(k) for k in names}).drop(*(f"{k}_{x}" for k in names for x in ("hits", "gaps", "ends")))


def _votes(kind: str, x: Column, base: bool) -> list[Column]:
    """Regex, checksum, gazetteer, surroundings' words and marks, length and variety; each 1, 0 or -1."""
    m, n = x["m"], F.length(_digits(x["m"]))
    no, yes = F.lit(weak.ABSTAIN), F.lit(1)
    plain = F.when(m.rlike("^[0-9a-f]{32,64}$") | m.rlike(r"^\(?[0-9]{3}\)? ?[0-9]{3}-[0-9]{4}$"), 1)
    regex = yes if base or kind in ("ssn", "iban") else plain.otherwise(no if kind == "email" else 0)
    check = {"card": F.when(_luhn(m), 1).otherwise(0), "ip": F.when(_octets(m) & ~m.rlike(r"(^|\.)0[0-9]"), 1).otherwise(0), "iban": F.when(_mod97(m), 1).otherwise(0)}.get(kind, no)
    known = {
        "email": F.when(m.rlike(_any_of(TOP_DOMAINS, "(?i)(?<![A-Za-z0-9-])(?:", ")$")), 1).when(m.rlike(_any_of(NO_DOMAINS, "(?i)(?<![A-Za-z0-9-])(?:", ")$")), 0).otherwise(no),
        "ip": F.when(m.rlike("^(?:0|22[4-9]|2[3-9][0-9])\\."), 0).otherwise(1),
        "card": F.when(_digits(m).rlike(_any_of(CARD_ISSUERS)), 1).otherwise(0),
        "phone": F.when(~m.startswith("+"), no).when(_digits(m).rlike(_any_of(CALLING_CODES)), 1).otherwise(0),
        "ssn": F.when(m.rlike("^(?:000|666|9)|-00-|-0000$"), 0).otherwise(1),
        "iban": F.when(m.rlike(_any_of(IBAN_COUNTRIES)), 1).otherwise(0),
        "secret": F.when(m.rlike(_any_of(KEY_PREFIXES)), 1).otherwise(no),
    }[kind]
    cue = F.when(x["pre"].rlike(rf"(?i)(?<![\p{{L}}])(?:{CUES})[^\p{{L}}]{{0,6}}$"), 1).when(x["pre"].rlike(rf"(?i)(?<![\p{{L}}])(?:{OTHER})[^\p{{L}}]{{0,4}}$"), 0).otherwise(no)
    open_, close = (x["pre"] == "") | x["pre"].rlike("[\\s\"'(<\\[,;:|=#*$%&]$"), (x["post"] == "") | x["post"].rlike("^[\\s\"')>\\],;:|.!?#*$%&]")
    around = F.when(open_ & close, 1).otherwise(0)
    length = {
        "card": F.when(n.isin(15, 16), 1).otherwise(0),
        "phone": F.when(_between(n, 9, 13), 1).otherwise(0),
        "ssn": F.when(_between(n, 9, 13), 1).otherwise(0),
        "email": F.when(m.rlike("[A-Za-z]{2,24}$"), 1).otherwise(0),
        "secret": F.when(_between(F.length(m), 32, 64), 1).otherwise(no),
    }.get(kind, no)
    chars = F.array_distinct(F.split(F.regexp_replace(m, "[^A-Za-z0-9]", ""), "(?!^)"))
    variety = no if kind in ("ip", "email") else F.when(F.size(chars) >= 5, 1).otherwise(0)
    return [v.cast("int") for v in (regex, check, known, cue, around, length, variety)]


N_VOTERS = 7


def _clear_of_base(df: DataFrame) -> DataFrame:
    """Takes those of ``more_`` away that a span of ``base_`` overlaps.

    Candidates by end and base spans by start, sorted together: one overlaps if the furthest end of the base spans before it lies
    beyond its start.
    """
    mark = lambda at, kind: lambda x: F.struct(x[at].alias("at"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    both = (F.size("more_") > 0) & (F.size("base_") > 0)
    df = df.withColumn("marks_", F.when(both, F.array_sort(F.concat(F.transform("more_", mark("e", 0)), F.transform("base_", mark("s", 1))))))
    df = running(df, {"reach_": F.transform("marks_", lambda x: F.when(x["kind"] == 1, x["e"]).otherwise(0))}, F.greatest)
    ends = F.transform(F.filter(F.zip_with("marks_", "reach_", lambda x, r: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), r.alias("r"))), lambda x: x["kind"] == 0), lambda x: x["r"] > x["s"])
    df = df.withColumn("hit_", F.when(both, ends))
    by_end = F.array_sort(F.transform("more_", lambda x, i: F.struct(x["e"].alias("e"), x["s"].alias("s"), x.alias("x"))))
    marked = F.zip_with(by_end, "hit_", lambda x, hit: F.struct(x["x"].alias("x"), hit.alias("hit")))
    left = F.transform(F.filter(marked, lambda x: ~x["hit"]), lambda x: x["x"])
    return df.withColumn("more_", F.when(both, left).otherwise(F.col("more_"))).drop("marks_", "reach_", "hit_")


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_`` (spans by the base rules) and ``more_`` (further candidates), arrays of (kind, s, e, votes, shape).

    Null counts as empty text. Give it few columns: names that end in an underscore are its own.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumns({"at_": F.contains(t, F.lit("@")), "digit_": t.rlike("[0-9]"), "marks_": t.rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]")})
    df = df.withColumn("long_", F.col("digit_") & t.rlike(f"(?<!{_KEY}){_KEY}{{24}}"))
    found = {f"m_{k}_": (PATTERNS[k], F.col("at_") if k == "email" else F.col("digit_")) for k in BASE}
    found |= {f"x_{k}_": (p, F.col("marks_") if k == "email" else F.col("long_") if k == "secret" else F.col("digit_")) for k, p in EXTRA.items()}
    df = matches(df, t, found)

    def as_span(kind: str, base: bool):
        def span(x: Column) -> Column:
            shape = F.least(F.lit(3), F.floor(F.length(x["m"]) / 12)).cast("int")
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.array(*_votes(kind, x, base)).alias("votes"), shape.alias("shape"))

        return span

    def valid(kind: str):
        return lambda x: _valid(kind, x["m"])

    def failed(x: Column) -> Column:
        return ~_valid("card", x["m"]) & _between(F.length(_digits(x["m"])), 13, 19)

    def further(kind: str):
        return lambda x: x["m"].rlike("[0-9]") if kind == "secret" else F.lit(True)

    base = F.concat(*(F.transform(F.filter(f"m_{k}_", valid(k)), as_span(k, True)) for k in BASE))
    more = F.concat(F.transform(F.filter("m_card_", failed), as_span("card", False)), *(F.transform(F.filter(f"x_{k}_", further(k)), as_span(k, False)) for k in EXTRA))
    df = df.withColumns({"base_": base, "more_": more}).drop("at_", "digit_", "long_", "marks_", *found)
    return _clear_of_base(df)


def classifier(found: DataFrame) -> list[float]:
    """Weights of the span classifier, trained on the posteriors of ``weak.fit`` over all candidates of ``found``.

    Weights: bias, then a vote of 1 and of 0 of each voter, then each kind, then each shape.
    """
    # outer, then filtered: for a plain explode Spark would test the array's size in a filter below, which repeats all expressions
    spans = found.select(F.explode_outer(F.concat("base_", "more_")).alias("x")).where("x is not null").select("x.kind", "x.votes", "x.shape")
    got = sorted((tuple(r["votes"]), r["kind"], r["shape"], r["count"]) for r in spans.groupBy("votes", "kind", "shape").count().collect())
    model = weak.fit([(v, n) for v, _, _, n in got], N_VOTERS)
    total = sum(n for *_, n in got) or 1
    rows = []
    for votes, kind, shape, n in got:
        at = [0, *(1 + 2 * i + (1 - v) for i, v in enumerate(votes) if v != weak.ABSTAIN), 1 + 2 * N_VOTERS + kind, 1 + 2 * N_VOTERS + len(KINDS) + shape]
        rows.append((at, model.posterior(list(votes)), n / total))
    w = [0.0] * (1 + 2 * N_VOTERS + len(KINDS) + 4)
    for _ in range(400):  # gradient ascent with a small ridge
        grad = [-0.002 * x for x in w]
        for at, q, share in rows:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(w[i] for i in at)))))
            for i in at:
                grad[i] += share * (q - p)
        w = [x + 2.0 * g for x, g in zip(w, grad, strict=True)]
    return w


def _score(x: Column, w: list[float]) -> Column:
    out = F.lit(w[0])
    for i in range(N_VOTERS):
        v = F.get(x["votes"], F.lit(i))
        out = out + F.when(v == 1, w[1 + 2 * i]).when(v == 0, w[2 + 2 * i]).otherwise(0.0)
    tail = [F.lit(v) for v in w[1 + 2 * N_VOTERS :]]
    return out + F.get(F.array(*tail[: len(KINDS)]), x["kind"]) + F.get(F.array(*tail[len(KINDS) :]), x["shape"])


def _sorted(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))


def decided(found: DataFrame, w: list[float]) -> DataFrame:
    """Adds ``spans_``: base spans and accepted candidates as (kind, s, e), by kind and start."""
    edge = math.log(ACCEPT / (1 - ACCEPT))
    accepted = F.when(F.size("more_") == 0, F.col("more_")).otherwise(F.filter("more_", lambda x: _score(x, w) >= edge))
    return found.withColumn("spans_", F.concat("base_", accepted)).withColumn("spans_", _sorted(F.col("spans_")))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


#: Code points of the blocks that a text is cut into, so that a piece is found without reading all before it.
_PIECE = 512


def _piece(start: Column, end: Column) -> Column:
    """Code points from start to end (exclusive) of the text whose blocks are ``blocks_``."""
    a, b = F.floor(start / _PIECE).cast("int"), F.floor(end / _PIECE).cast("int")
    first, last = F.coalesce(F.get("blocks_", a), F.lit("")), F.coalesce(F.get("blocks_", b), F.lit(""))
    between = F.array_join(F.slice(F.col("blocks_"), a + 2, F.greatest(b - a - 1, F.lit(0))), "")
    return F.when(a == b, F.substring(first, start % _PIECE + 1, end - start)).otherwise(F.concat(F.substring(first, start % _PIECE + 1, F.lit(_PIECE)), between, F.substring(last, F.lit(1), end % _PIECE)))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets, and n_chars recounted if there is such a column.

    Overlapping spans are replaced together, by the first one's kind. Null stays null; repeated rows change alike; all other
    columns pass through, whatever their names.
    """
    wide = docs.select(F.struct(*docs.columns).alias("row_"), F.col("text").alias("text_"))
    found = cut(candidates(wide, "text_").drop("text_"), "spans")
    return _replaced(decided(found, classifier(found)), docs.columns)


def _replaced(found: DataFrame, columns: list[str]) -> DataFrame:
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    found = found.withColumn("text_", F.col("row_.text"))
    found = found.withColumn("by_", F.array_sort(F.transform("spans_", lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))))
    found = running(found, {"reach_": F.transform("by_", lambda x: x["e"])}, F.greatest)
    found = found.withColumn("blocks_", F.when(F.size("by_") > 0, F.regexp_extract_all("text_", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    # a span that begins before the furthest end so far belongs to what is replaced there already
    after = F.concat(F.array(F.lit(0)), F.slice("reach_", F.lit(1), F.size("by_") - 1))
    left = F.filter(F.zip_with("by_", after, lambda x, a: F.struct(a.alias("after"), x["s"].alias("s"), x["kind"].alias("kind"))), lambda x: x["s"] >= x["after"])
    head = F.array_join(F.transform(left, lambda x: F.concat(_piece(x["after"], x["s"]), F.get(names, x["kind"]))), "")
    tail = _piece(F.element_at("reach_", -1), F.length("text_"))
    found = found.withColumn("new_", F.when(F.size("by_") > 0, F.concat(head, tail)).otherwise(F.col("text_")))
    own = {"text": F.col("new_")}
    if "n_chars" in columns:
        own["n_chars"] = F.when(F.size("by_") > 0, F.length("new_").cast("long")).otherwise(F.col("row_.n_chars"))
    return found.select(*(own.get(c, F.col(f"row_.`{c}`")).alias(c) for c in columns))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    found = cut(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii")
    out = decided(found, classifier(found))
    base = _sorted(F.col("base_"))

    def of_kind(i: int):
        return lambda x: x["kind"] == i

    counts = [F.size(F.filter("base_", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return out.select("doc_id", *counts, F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("spans_")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
