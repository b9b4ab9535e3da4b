"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
from collections import defaultdict

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text):
    w = SPACE.findall((text or "").translate(AZ))
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def near_duplicates(rows, threshold=85):
    """rows: (doc_id, text) with unique doc_ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                inter = len(sets[x] & sets[y])
                if 100 * inter >= threshold * (len(sets[x]) + len(sets[y]) - inter):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def decontaminate(docs, items):
    found = []
    for item, text in items:
        w = ALNUM.findall((text or "").translate(AZ))
        n = min(len(w), 13)
        found += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1)] if w else []
    out = []
    for doc, text in docs:
        w = ALNUM.findall((text or "").translate(AZ))
        hit, its = set(), set()
        for item, g in found:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    if item is not None:
                        its.add(item)
        listed = ",".join(sorted(map(str, its)))
        out.append((doc, len(w), len(hit), len(its), hashlib.sha256(listed.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def remove_repeats(rows, k=20):
    """rows: (doc_id, text) with unique doc_ids."""
    first, words = {}, {i: SPACE.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for p in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][p:p + k]), (i, p))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - k + 1):
            if first[tuple(w[p:p + k])] != (i, p):
                gone.update(range(p, p + k))
        left = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


def targets(sizes):
    """Source sizes (None allowed) to targets: shares by weight, full sources reshared."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**full, **share}
        full.update({s: 3 * sizes[s] for s in over})


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s):
    return re.sub("[^0-9]", "", s)


RULES = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(_digits(s)) <= 19 and _luhn(_digits(s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(_digits(s)) <= 15),
]


def personal_data(text):
    spans = sorted((m.start(), i, m.end()) for i, (_, p, ok) in enumerate(RULES)
                   for m in p.finditer(text or "") if ok(m.group()))
    listed = ",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans)
    return (*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(listed.encode()).hexdigest()), listed


def top_k(rows, k, every):
    import math
    vec = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in vec:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vec if i != q and len(w) == len(v))
            out.update((q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k]))
    return out


def groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    return by
