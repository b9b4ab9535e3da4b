"""Independent pure-Python BLEU / chrF used as test oracles (not used by the
package).  Same public formulas, written the obvious way with Counters."""

import math
from collections import Counter

import re

# The public Treebank-style word rules, in Python's own pattern language.
BEFORE = [(re.compile(p), r) for p, r in (
    ("([«“‘„]|[`]+)", r" \1 "),
    ("^\"", "``"),
    ("(``)", r" \1 "),
    (r"([ \(\[{<])(\"|\'{2})", r"\1 `` "),
    (r"(?i)(\')(?!re|ve|ll|m|t|s|d|n)(\w)\b", r"\1 \2"),
    (r"([^\.])(\.)([\]\)}>\"\'»”’ ]*)\s*$", r"\1 \2 \3 "),
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"\.{2,}", r" \g<0> "),
    (r"[;@#$%&]", r" \g<0> "),
    (r"([^\.])(\.)([\]\)}>\"\']*)\s*$", r"\1 \2\3 "),
    (r"[?!]", r" \g<0> "),
    (r"([^'])' ", r"\1 ' "),
    (r"[*]", r" \g<0> "),
    (r"[\]\[\(\)\{\}\<\>]", r" \g<0> "),
    (r"--", r" -- "),
)]
AFTER = [(re.compile(p), r) for p, r in (
    ("([»”’])", r" \1 "),
    (r"''", " '' "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    *((p, r" \1 \2 ") for p in (
        r"(?i)\b(can)(not)\b", r"(?i)\b(d)('ye)\b", r"(?i)\b(gim)(me)\b", r"(?i)\b(gon)(na)\b", r"(?i)\b(got)(ta)\b",
        r"(?i)\b(lem)(me)\b", r"(?i)\b(more)('n)\b", r"(?i)\b(wan)(na)(?=\s)", r"(?i) ('t)(is)\b", r"(?i) ('t)(was)\b")),
)]


def tokens(s):
    s = s or ""
    for p, r in BEFORE:
        s = p.sub(r, s)
    s = f" {s} "
    for p, r in AFTER:
        s = p.sub(r, s)
    return s.split()


def ngrams(seq, n):
    return Counter(tuple(seq[i:i + n]) for i in range(len(seq) - n + 1))


def bleu(reference, candidate, max_n=4, k=5.0):
    ref, hyp = tokens(reference), tokens(candidate)
    hl, rl = len(hyp), len(ref)
    precisions = []
    for n in range(1, max_n + 1):
        h, r = ngrams(hyp, n), ngrams(ref, n)
        num = sum(min(c, r[g]) for g, c in h.items())
        den = max(1, sum(h.values()))
        precisions.append((num, den))
    if precisions[0][0] == 0:
        return 0.0
    ps, inc = [], 1
    for num, den in precisions:
        if num == 0 and hl > 1:
            ps.append((1 / (2 ** inc * k / math.log(hl))) / den)
            inc += 1
        else:
            ps.append(num / den)
    s = math.fsum(1.0 / max_n * math.log(p) for p in ps if p > 0)
    if hl > rl:
        bp = 1.0
    elif hl == 0:
        bp = 0.0
    else:
        bp = math.exp(1 - rl / hl)
    return bp * math.exp(s)


def chrf(reference, candidate, order=6, beta=2.0):
    ref, hyp = "".join((reference or "").split()), "".join((candidate or "").split())
    sp = sr = 0.0
    eff = 0
    for n in range(1, order + 1):
        h, r = ngrams(hyp, n), ngrams(ref, n)
        nh, nr = sum(h.values()), sum(r.values())
        if nh > 0 and nr > 0:
            m = sum(min(c, r[g]) for g, c in h.items())
            sp += m / nh
            sr += m / nr
            eff += 1
    if eff == 0:
        return 0.0
    p, r = sp / eff, sr / eff
    f = beta * beta
    return (1 + f) * p * r / (f * p + r) if p + r > 0 else 0.0
