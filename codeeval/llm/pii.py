"""Operator 8: personal data by weak supervision, in DataFrame functions only.

Base spans follow fixed rules per kind (``RULES``: a pattern, leftmost and not
overlapping, then a check).  Candidates are all matches of those patterns that
look plausible, failing ones included, and of looser ones (``LOOSE``: written
out e-mail addresses, national phone numbers).  Labelers vote on each:

* regex: the base rule holds;
* checksum or range: Luhn, address parts, digit count, address length;
* gazetteer: top-level domains, card issuers, dialling codes, address ranges;
* context: a telling word shortly before;
* boundary: no letter or digit touches the span.

Expectation-maximisation estimates, per kind, how often each labeler fires on
true and on false candidates, from the counts of vote patterns alone.  The
probabilities it gives train the final classifier, a logistic regression on
votes and ``SHAPES`` of the span, and candidates it scores ``ACCEPT`` or more
are added to the base spans, which always stay.  Both fits see one row per
kind and pattern, at most 4 * 2^8, however many documents there are.

Positions are code points, end exclusive.  Null and empty texts have no spans.
Rows stand alone, also when they repeat a doc_id.  Other columns are ignored.
Patterns use possessive loops and start only where a run starts, so time is
linear in the length of a text and nothing recurses.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import saved, text_of

KINDS = ("email", "ip", "card", "phone")
#: \\G: the end of the last match, where a match may begin inside a run.
RULES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+"
             r"(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "phone": r"(?<![0-9A-Za-z+().-])(?<![0-9+][\x20().-]{1,2})(?:\([0-9]{2,5}\)\x20?|0[0-9]{1,4}[\x20./-])"
             r"[0-9]{3,4}[\x20.-]?[0-9]{3,5}(?![0-9A-Za-z])(?![\x20.-][0-9])",
}
#: Fixed values of the gazetteers.
TLDS = ("com", "org", "net", "edu", "gov", "io", "info", "biz", "co", "eu", "de", "fr", "es", "it", "uk", "us", "ch",
        "at", "nl", "be", "pl", "se", "pt", "br", "mx", "ar", "ca", "au", "jp", "cn", "in", "ru")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
DIAL = r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|0|\()"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|kontakt|correo|courriel|write to|reach)[^\n]{0,24}$",
    "ip": r"(?i)(?:\bip\b|address|adresse|server|host|direcci)[^\n]{0,24}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|karte|tarjeta|carte)[^\n]{0,24}$",
    "phone": r"(?i)(?:phone|\btel\b|call|mobile|fax|telefon|t.l.fono|t.l.phone)[^\n]{0,24}$",
}
LABELERS, SHAPES = 5, 3
BEFORE = 48
ACCEPT = 0.9
_STEP = 128
_CANDIDATE = "struct<kind: int, begin: int, end: int, base: boolean, votes: int>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix_sums(x: Column) -> Column:
    """Sum of the elements before each, in two levels so long arrays stay cheap."""
    add = lambda a, v: a + v

    def sums(x: Column) -> Column:
        last = F.floor((F.size(x) - 1) / _STEP).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last),
                             lambda b: F.aggregate(F.slice(x, b * _STEP + 1, F.lit(_STEP)), F.lit(0), add))
        starts = lambda blocks: F.transform(F.sequence(F.lit(0), last),
                                            lambda b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), add))
        return _let(_let(blocks, starts), lambda before: F.transform(
            F.sequence(F.lit(0), F.size(x) - 1),
            lambda i: F.element_at(before, F.floor(i / _STEP).cast("int") + 1) + F.aggregate(
                F.slice(x, F.floor(i / _STEP).cast("int") * _STEP + 1, i % _STEP), F.lit(0), add)))
    return _let(x, sums)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.aggregate(
        F.array(F.substring(d, i, F.lit(1)).cast("int")), F.lit(0),
        lambda z, v: F.when((n - i) % 2 == 0, v).when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def _votes(kind: str, m: Column, d: Column, loose: bool, before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Whether the base rule holds, whether the match is worth voting on, and the votes as bits."""
    n = F.length(d)
    if kind == "email":
        ok = F.length(m) <= 254
        known = F.lower(F.substring_index(m, ".", -1)).isin(*TLDS)
        base, worth = F.lit(not loose), F.lit(True)
    elif kind == "ip":
        ok = m.rlike(r"^(?:0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
        known = ok & ~m.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.") & m.rlike(r"[0-9]{2}")
        base, worth = ok, F.lit(True)
    elif kind == "card":
        ok = n.between(14, 19) & _luhn(d)
        known = d.rlike(ISSUERS)
        base, worth = ok, n.between(13, 19)
    else:
        ok = n.between(10, 15) if not loose else n.between(7, 13)
        known = m.rlike(DIAL)
        base, worth = (F.lit(False) if loose else ok), n.between(7, 17)
    bits = [base, ok, known, before.rlike(CONTEXT[kind]),
            ~before.rlike(r"[\p{L}0-9]$") & ~after.rlike(r"^[\p{L}0-9]"),
            m.rlike(r"[\x20()-]"), (before == "") | before.rlike(r"\n$"), before.rlike(r"[|,;:\t][\x20]?$")]
    votes = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return base, worth, votes


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: the candidates of every row's whole text, as ``kind,
    begin, end, base, votes``."""
    texts = text_of(docs).withColumn("text", F.coalesce("text", F.lit("")))
    sources = [(k, False, RULES[k]) for k in KINDS] + [(k, True, p) for k, p in LOOSE.items()]
    # A pattern is only tried where a character that it needs occurs.
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "card": F.lit(True),
             "ip": F.contains("text", F.lit("."))}
    at = F.lower("text").rlike(r"[\[(]at[\])]")
    none = F.array().cast("array<string>")
    matched = texts.select("doc_id", "text", *(
        F.when(at if loose and k == "email" else F.lit(True) if loose else needs[k],
               F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{i}")
        for i, (k, loose, p) in enumerate(sources)))
    split = matched.select("doc_id", *(f"m{i}" for i in range(len(sources))), *(
        F.when(F.size(f"m{i}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g{i}")
        for i, (_, _, p) in enumerate(sources)))
    placed = split.select("doc_id", *(
        F.when(F.size(f"m{i}") > 0, F.arrays_zip(
            F.col(f"m{i}").alias("m"),
            F.transform(F.slice(F.col(f"g{i}"), 1, F.size(f"m{i}")), lambda g: F.substring(g, F.lit(-BEFORE), F.lit(BEFORE))).alias("before"),
            F.transform(F.slice(F.col(f"g{i}"), 2, F.size(f"m{i}")), lambda g: F.substring(g, 1, 1)).alias("after"),
            F.transform(F.slice(F.col(f"g{i}"), 1, F.size(f"m{i}")), F.length).alias("gap"),
            _prefix_sums(F.zip_with(F.slice(F.col(f"g{i}"), 1, F.size(f"m{i}")), F.col(f"m{i}"),
                                    lambda g, m: F.length(g) + F.length(m))).alias("so_far"))).alias(f"c{i}")
        for i in range(len(sources))))

    def judged(i: int, kind: str, loose: bool) -> Column:
        def one(c: Column) -> Column:
            # no rule takes more than 19 digits; with more there are still too many
            return _let(F.substring(_digits(c["m"]), 1, 20), lambda d: with_digits(c, d))

        def with_digits(c: Column, d: Column) -> Column:
            base, worth, votes = _votes(kind, c["m"], d, loose, c["before"], c["after"])
            begin = c["so_far"] + c["gap"]
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), begin.alias("begin"),
                            (begin + F.length(c["m"])).alias("end"), base.alias("base"), votes.alias("votes"),
                            worth.alias("worth"))
        found = F.filter(F.transform(F.col(f"c{i}"), one), lambda c: c["base"] | c["worth"])
        kept = F.transform(found, lambda c: F.struct(*(c[n].alias(n) for n in ("kind", "begin", "end", "base", "votes"))))
        return F.coalesce(kept, F.array().cast(f"array<{_CANDIDATE}>"))

    return placed.select("doc_id", F.concat(*(judged(i, k, loose) for i, (k, loose, _) in enumerate(sources))).alias("found"))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """EM over vote patterns of one kind: probability of a true span by pattern.

    Starts from the share of labelers that fire; labelers are taken to err
    independently, each with its own rates on true and false candidates."""
    total = sum(counts.values())
    bit = lambda v, j: v >> j & 1
    p = {v: min(max(sum(bit(v, j) for j in range(LABELERS)) / LABELERS, 0.02), 0.98) for v in counts}
    for _ in range(rounds):
        true = sum(counts[v] * p[v] for v in counts)
        prior = (true + 1) / (total + 2)
        hit = [(sum(counts[v] * p[v] * bit(v, j) for v in counts) + 1) / (true + 2) for j in range(LABELERS)]
        false = [(sum(counts[v] * (1 - p[v]) * bit(v, j) for v in counts) + 1) / (total - true + 2) for j in range(LABELERS)]
        for v in counts:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(hit[j] / false[j]) if bit(v, j) else math.log((1 - hit[j]) / (1 - false[j]))
                for j in range(LABELERS))
            p[v] = 1 / (1 + math.exp(-max(min(odds, 30), -30)))
    return p


def train(counts: dict[int, int], p: dict[int, float], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic regression on the bits of a pattern, towards ``p``; the first weight is the constant."""
    n = LABELERS + SHAPES
    x = {v: [1.0] + [float(v >> j & 1) for j in range(n)] for v in counts}
    w, total = [0.0] * (n + 1), sum(counts.values())
    for _ in range(steps):
        grad = [0.002 * a for a in w]
        for v, c in counts.items():
            z = sum(a * b for a, b in zip(w, x[v]))
            e = (1 / (1 + math.exp(-max(min(z, 30), -30))) - p[v]) * c / total
            grad = [g + e * b for g, b in zip(grad, x[v])]
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def classifier(found: DataFrame) -> dict[int, list[float]]:
    """Weights per kind, from the counts of vote patterns (at most 4 * 2^8 rows)."""
    rows = (found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
            .orderBy("kind", "votes").collect())
    weights = {}
    for kind in sorted({r["kind"] for r in rows}):
        counts = {r["votes"]: r["n"] for r in rows if r["kind"] == kind}
        by_labels: dict[int, int] = {}
        for v, n in counts.items():
            low = v & (1 << LABELERS) - 1
            by_labels[low] = by_labels.get(low, 0) + n
        p = reliabilities(by_labels)
        weights[kind] = train(counts, {v: p[v & (1 << LABELERS) - 1] for v in counts})
    return weights


def personal_data(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``doc_id, spans``: every row's spans as ``kind, begin, end, base, score``,
    by begin and then kind."""
    found = saved(candidates(docs), "candidates")
    weights = classifier(found)

    def scored(c: Column) -> Column:
        total = F.lit(0.0)
        for kind, w in weights.items():
            z = F.lit(w[0])
            for j, a in enumerate(w[1:]):
                z = z + F.when(c["votes"].bitwiseAND(1 << j) > 0, a).otherwise(0.0)
            total = F.when(c["kind"] == kind, 1 / (1 + F.exp(-z))).otherwise(total)
        return F.struct(c["begin"].alias("begin"), c["kind"].alias("kind"), c["end"].alias("end"),
                        c["base"].alias("base"), total.alias("score"))

    spans = F.filter(F.transform("found", scored), lambda c: c["base"] | (c["score"] >= accept))
    return found.select("doc_id", F.array_sort(spans).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:begin:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(
        ":", F.element_at(names, c["kind"] + 1), c["begin"].cast("string"), c["end"].cast("string"))))


def summary(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` from
    ``personal_data``; the counts are of base spans."""
    base = F.filter("spans", lambda c: c["base"])

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == i))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
