"""Operators 11 to 13 against plain Python versions, on awkward small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeeval.llm import epsjoin, runs, trie
from codeeval.llm import words as W

from . import brute
from .test_operators import documents

# ---------------------------------------------------------------- 11


def lyndon(s):
    """Longest Lyndon word at each place: up to the next smaller suffix."""
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[i:] < s[j:]:
            j += 1
        out.append(j - i)
    return out


def runs_of(w, least=12):
    """(start, length, period) of all runs, period by period."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(w):
    gone = {i for s, n, q in runs_of(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(w), h // 10
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_arrays(s):
    assert runs.lyndon_array(np.array(s, np.int64))[0].tolist() == lyndon(s)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 60), st.integers(0, 2))
def test_runs_of_random_words(s, cut, k):
    s = [x * k for x in s]
    h, part = W.mix(np.array(s, np.uint64) + W.U64(5)), (np.arange(len(s)) >= cut).astype(np.int64)
    at, stretch = runs.repeating(h, part)
    got = [(int(at[a]), n, q) for a, n, q in runs.runs_of(h[at], stretch).tolist()]
    cut = min(cut, len(s))
    assert sorted(got) == sorted(runs_of(s[:cut]) + [(a + cut, n, q) for a, n, q in runs_of(s[cut:])])


@pytest.mark.parametrize("collide", (False, True))
def test_structured_words(monkeypatch, collide):
    """Fibonacci and Thue-Morse words, also where the prefix sums tell too much equal."""
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    if collide:
        equal = runs.Extensions._equal
        monkeypatch.setattr(runs.Extensions, "_equal", lambda self, i, j, n: equal(self, i, j, n) | (n == 7))
    for s in (b, [bin(i).count("1") % 2 for i in range(256)], [0] * 50, list(range(50)), [1, 2, 3] * 10 + [1, 2, 4] * 9):
        got = [tuple(x) for x in runs.runs_of(W.mix(np.array(s, np.uint64)), np.zeros(len(s), np.int64)).tolist()]
        if not collide:
            assert got == runs_of(s)
        assert all(x in runs_of(s) for x in got)


def test_runs_of_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice((2, 3, 500)))}" for _ in range(rng.randrange(120)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t\n"), (403, "one"), (None, "a b " * 20), (404, "é ü " * 9), (404, "é ü " * 9),
             (405, "x " * 3000), (406, "a b c\x85d " * 8 + "a b " * 30)]
    got = runs.periodic_runs(documents(spark, rows)).collect()
    want = []
    for i, t in rows:
        w = brute.SPACE.findall(t or "")
        want.append((i, len(w), tuple(runs_of(w)), collapsed(w)))
    key = repr
    assert sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in got), key=key) == sorted(want, key=key)


def test_digests_of_planted_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(90)))) for i in range(250)] + [(None, "a " * 20), (9, None)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = planted(i, brute.SPACE.findall(t or ""))
        found = runs_of(w)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want.append((i, len(found), *best, 1000 * best[1] // best[2] if found else None,
                     sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w))))
    got = runs.digests(runs.periodic_runs(runs.with_planted_runs(documents(spark, rows))))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert sum(r[1] > 0 for r in want) > 10
    assert runs.digests(runs.periodic_runs(documents(spark, []))).count() == 0


# ---------------------------------------------------------------- 12

EMBEDDINGS = "vec_id long, embedding array<double>, label int, name string, component long, n int"


def near_vectors(rows, cosine=0.95):
    """(vec_id, n_links, component_id, kept) of each row."""
    def good(i, v):
        return i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, links = len(rows), defaultdict(list)
    for a in range(n):
        for b in range(a):
            (i, v), (j, w) = rows[a], rows[b]
            if good(i, v) and good(j, w) and len(v) == len(w):
                dot = math.fsum(x * y for x, y in zip(v, w))
                if v == w or dot >= cosine * math.sqrt(math.fsum(x * x for x in v)) * math.sqrt(math.fsum(x * x for x in w)):
                    links[a].append(b), links[b].append(a)
    out, seen = [None] * n, set()
    for a in range(n):
        if a not in seen:
            group, todo = [], [a]
            seen.add(a)
            while todo:
                x = todo.pop()
                group.append(x)
                for y in links[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
            least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
            for x in group:
                out[x] = (rows[x][0], len(links[x]), least, rows[x][0] == least)
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 5, 7) for i, v in rows], EMBEDDINGS).repartition(3)


def judged(spark, rows, **more):
    return Counter(map(tuple, epsjoin.near_vectors(vectors(spark, rows), **more).collect()))


@pytest.mark.parametrize("dim,noise", ((3, 0.1), (16, 0.05), (40, 0.04)))
def test_near_vectors(spark, dim, noise, monkeypatch):
    monkeypatch.setattr(epsjoin, "BLOCK_BYTES", 1)          # small sequences, so that there are some levels
    monkeypatch.setattr(epsjoin, "PIECE", 16)
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(60, dim))
    near = base[rng.integers(0, 60, 340)] * rng.uniform(0.1, 9, (340, 1)) + noise * rng.normal(size=(340, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]                 # a hot vector
    got = judged(spark, rows)
    assert got == near_vectors(rows) and max(r[1] for r in got) >= 60


def test_chains_are_followed_past_near_ones(spark):
    angle = math.acos(0.95) * 0.999
    rows = [(100 - i, [math.cos(i * angle), math.sin(i * angle)]) for i in range(12)]
    got = judged(spark, rows)
    assert got == near_vectors(rows) and {r[2] for r in got} == {89}


def test_near_vectors_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]),
            (8, [1.0, 0.0, 0.0]), (9, [2.0, -0.0]), (9, [2.0, 0.0]), (9, [0.0, 1.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]),
            (11, [5.0]), (12, [1e-200]), (13, [1e300, 0.0]), (14, [0.95, math.sqrt(1 - 0.95 ** 2)])]
    got = judged(spark, rows)
    want = near_vectors([(i, v) for i, v in rows if i not in (12, 13, 14)])     # these overflow in a plain sum
    ids = lambda c: {r[0] for r in c}
    assert ids(got) == {i for i, _ in rows} and sum(got.values()) == len(rows)
    assert {r for r in got if r[0] in (1, 2, 3, 4, 5, 6, 8, 10, None)} == {r for r in want if r[0] in (1, 2, 3, 4, 5, 6, 8, 10, None)}
    linked = {r[0]: r[1:] for r in got if r[0] in (7, 11, 12, 13)}
    assert linked[7][1:] == (7, True) and linked[13][1] == 7 and linked[11] == (1, 11, True) and linked[12] == (1, 11, False)
    assert sum(got.values()) == len(rows) and sum(judged(spark, []).values()) == 0


def test_float_vectors_and_a_lower_threshold(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 4)).astype(np.float32))]
    df = vectors(spark, rows).selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding")
    got = Counter(map(tuple, epsjoin.near_vectors(df, 0.8).collect()))
    assert got == near_vectors(rows, 0.8) and max(r[1] for r in got) > 1


# ---------------------------------------------------------------- 13

CONVERSATIONS = "conv_id long, turn long, role string, text string, pos int, p long, depth int, n int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 3, 4, 5, 6) for r in rows], CONVERSATIONS).repartition(3)


def turn_lists(rows):
    """conv_id to its turns, ordered by turn with null first (turns are distinct in these tests)."""
    out = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            out[c].append((role or "", text or ""))
    return dict(out)


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def trie_nodes(turns):
    members = defaultdict(list)
    for c, w in turns.items():
        for d in range(len(w) + 1):
            members[tuple(w[:d])].append(c)
    children = Counter(w[:-1] for w in members if w)
    leaves, saved = Counter(), Counter()
    for w, m in members.items():
        for d in range(len(w) + 1):
            leaves[w[:d]] += not children[w]
            saved[w[:d]] += (len(m) - 1) * len(w[-1][1]) if w else 0
    out = Counter()
    for w, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(turns[c]) == len(w))))
        out[min(m), len(w), min(members[w[:-1]]) if w else None, len(m), children[w], leaves[w], saved[w],
            hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in [*range(180), 300, 405, -7, 10 ** 12 + 3]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, None if t == 0 and c % 7 == 0 else t, rng.choice(("user", None, "assistant")), rng.choice(("é", "a😀", "", None))))
    rows += [(None, 1, "user", "no id")]
    got = found(trie.prefix_trie(*trie.rebuilt(conversations(spark, rows))))
    assert got == trie_nodes(rebuilt(turn_lists(rows))) and sum(got.values()) > 100


def test_trie_of_long_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "ID_BLOCK", 4)
    rows = [(c, t, "user", f"t{t}") for c in range(5) for t in range(40 + c)]            # a long path with copies
    rows += [(c, t, "user", f"x{t % 2}") for c in range(20, 60) for t in range(3)]       # a hot conversation
    rows += [(70, 0, "user", "t0"), (71, 0, "user", "t0"), (71, 1, "user", "end")]
    lists = turn_lists(rows) | {80: [], -3: []}
    df = conversations(spark, rows)
    ids = spark.createDataFrame([(c,) for c in lists], "conv_id long")
    assert found(trie.prefix_trie(trie.turns_of(df), ids)) == trie_nodes(lists)


def test_trie_edge_cases(spark):
    none = conversations(spark, [])
    assert found(trie.prefix_trie(*trie.rebuilt(none))) == Counter()
    ids = spark.createDataFrame([(3,), (2,)], "conv_id long")
    assert found(trie.prefix_trie(trie.turns_of(none), ids)) == trie_nodes({2: [], 3: []})
    again = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "user", "a")]     # repeated rows are turns
    assert found(trie.prefix_trie(trie.turns_of(conversations(spark, again)),
                                  spark.createDataFrame([(1,), (2,)], "conv_id long"))) == trie_nodes(turn_lists(again))
