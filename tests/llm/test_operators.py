"""Each operator against a plain Python version, on awkward small tables."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeeval.llm import (chat, components, debruijn, decontaminate, minhash, mixing, pii, quality, sharding, topk,
                          words)

from . import brute

# columns of the documents table, and some whose names clash with those the operators make
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_words int, component_id string, "
          "tag int, size string, shard int, score string")


def documents(spark, rows, sources=("a",)):
    rows = [(i, t, None, sources[n % len(sources)], None, 7, "x", 1, "y", 3, "z") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def sentence(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(rng, n, length, edits):
    base = sentence(rng, length)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


# ---------------------------------------------------------------- words

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ0 \t\x0b\x1f\n.é€😀\x7f", max_size=40)), max_size=6))
def test_words_are_those_of_the_patterns(texts):
    for table, pattern, lower in ((words.SPACE_WORDS, brute.SPACE, False), (words.ALNUM_WORDS, brute.ALNUM, True)):
        for row, buf, offs in words.chunks(pa.array(texts, pa.string()), 16):
            w = words.split_words(buf, offs, table, lower)
            for d in range(len(offs) - 1):
                t = texts[row + d] or ""
                got = [w.buf[a:b].tobytes().decode() for a, b in zip(w.start[w.first[d]:w.first[d + 1]],
                                                                    w.end[w.first[d]:w.first[d + 1]])]
                assert got == pattern.findall(t.translate(brute.AZ) if lower else t)


def test_word_hashes_depend_on_the_word_alone():
    texts = ["ab abc " + "x" * 300 + " abcdefgh abcdefghi", "x" * 300 + " abcdefghi abc", "abcdefgh ab"]
    seen = {}
    for _, buf, offs in words.chunks(pa.array(texts), 4):
        w = words.split_words(buf, offs, words.SPACE_WORDS)
        for a, b, h in zip(w.start, w.end, w.hashes()):
            assert seen.setdefault(buf[a:b].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen) == 5


def test_window_hashes_of_equal_windows_are_equal():
    h = np.random.default_rng(0).integers(0, 2**63, 60).astype(np.uint64)
    for k in (1, 2, 5, 13, 20):
        twice = words.window_hashes(np.concatenate([h, h]), k)
        assert (twice[:60 - k + 1] == twice[60:]).all() and len(set(twice.tolist())) == 60


# ---------------------------------------------------------------- 1

def test_near_duplicates(spark):
    rng = random.Random(3)
    texts = [None, "", " \t ", "One two", "one TWO", "one two three", "a b c d e", "A b c d e"]
    texts += near_copies(rng, 60, 150, 4) + near_copies(rng, 25, 40, 2) + near_copies(rng, 12, 400, 30)
    texts += [" ".join(sentence(rng, 60)) for _ in range(10)] + ["same text of more than five words"] * 30
    texts.append(" ".join(sentence(rng, 30000, 10 ** 6)))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_without_rows_or_ids(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v"), (None, None)]
    got = Counter(tuple(r)[:4] for r in minhash.near_duplicates(documents(spark, rows)).collect())
    assert got == Counter({(None, 2, 4, False): 1, (4, 2, 4, True): 2, (None, 2, None, True): 1, (None, 0, None, True): 1})


def test_prefix_filter_keeps_every_link(spark):
    rng = random.Random(9)
    texts = near_copies(rng, 80, 120, 3)
    sets = [np.unique(minhash.shingle_sets(*words.text_bytes(pa.array([t])))[0]) for t in texts]
    df = spark.createDataFrame([(i, len(s), i, [int(x) for x in s.view(np.int64)]) for i, s in enumerate(sets)],
                               "node long, n long, component long, shingles array<long>")
    pairs = {tuple(sorted(r)) for r in minhash._undecided(df).collect()}
    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            inter = len(np.intersect1d(a, sets[j]))
            if 0 < 100 * inter >= 85 * (len(a) + len(sets[j]) - inter) and len(a) + len(sets[j]) > 2 * inter:
                links.add((j, i))
    assert links and links <= pairs


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 10 for i in range(10, 41)}, **{i: 100 for i in range(100, 140)}}


# ---------------------------------------------------------------- 2

def test_decontaminate(spark):
    rng = random.Random(5)
    items = [(i, " ".join(sentence(rng, n, 300))) for i, n in enumerate((30, 13, 12, 14, 20, 1, 2, 6, 40))]
    items += [(10, items[0][1]), (11, None), (12, ""), (None, " ".join(sentence(rng, 15, 300)))]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[5][1]), (4, items[0][1].upper())]
    for i in range(5, 60):
        w = sentence(rng, rng.randint(1, 80), 300)
        source = rng.choice(items)[1] or ""
        cut = source.split()[rng.randint(0, 5):rng.randint(8, 40)]
        at = rng.randint(0, len(w))
        docs.append((i, " ,".join(w[:at] + cut + w[at:])))
    docs += [docs[8], (8, items[1][1]), (None, items[3][1])]
    got = decontaminate.decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute.decontaminate(docs, items)))


def test_decontaminate_empty(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.decontaminate(documents(spark, [(1, "a b")]), items).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontaminate(documents(spark, []), some).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=60))
def test_winnowing_keeps_a_fingerprint_in_every_window(ws):
    h = words.mix(np.array(ws, np.uint64) + np.uint64(1))
    grams = words.window_hashes(h, decontaminate.GRAM)
    kept = set(decontaminate.winnow(grams, np.arange(len(ws) - 12)).tolist())
    assert all(kept & set(range(s, s + 8)) for s in range(len(ws) - 12))


# ---------------------------------------------------------------- 3

def mix(spark, rows, sources, **options):
    docs = documents(spark, rows, sources)
    weights = spark.createDataFrame([(i, w) for i, w in ((0, 3.0), (1, 0.0), (2, float("nan")), (3, None))],
                                    "doc_id long, weight double")
    return mixing.mix_sources(docs, weights, **options)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 50, 400)))) for i in range(400)] + [(400, None), (None, "a b c")]
    sources = ["a", "b", None, "é", "a", "a", "c"]
    out = mix(spark, rows, sources).collect()
    sizes = Counter()
    for n, (_, t) in enumerate(rows):
        sizes[sources[n % 7]] += len((t or "").split())
    want = brute.targets(sizes)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        epochs = math.floor(r.target / r.source_size) if r.source_size else 0
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        assert epochs * r.size <= r.taken <= min(3, epochs + 1) * r.size
    assert len(out) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mix(spark, rows[::-1][1:] + rows[-1:], sources)  # other order of rows: other sources, same rules
    assert again.count() == len(rows)
    assert sorted(map(str, mix(spark, rows, sources).collect())) == sorted(map(str, out))


def test_mixing_whole_documents_and_small_sources(spark):
    rows = [(i, " ".join(["w"] * (i % 9))) for i in range(200)]
    for r in mix(spark, rows, ["a", "b", "b", "b"], whole_documents=True).collect():
        assert r.size == 0 or (r.taken % r.size == 0 and r.taken <= 3 * r.size)
    assert mix(spark, [], ["a"]).count() == 0
    assert [tuple(r)[2:] for r in mix(spark, [(1, None)], [None]).collect()] == [(0, 0, 0.0, 0)]
    capped = mix(spark, [(1, "a b"), (2, "a " * 50)], ["a", "b"]).collect()  # a stops at 3 times its size
    assert {r.source: (r.target, r.taken) for r in capped} == {"a": (6.0, 6), "b": (46.0, 46)}


def test_mixing_prefers_heavy_weights(spark):
    docs = documents(spark, [(i, "w " * 10) for i in range(1200)], ["a", "b", "b"])
    weights = spark.createDataFrame([(i, 50.0 if i % 2 else 0.02) for i in range(1200)], "doc_id long, weight double")
    out = [r for r in mixing.mix_sources(docs, weights).collect() if r.source == "b"]  # 2/7 of all: a part of b
    heavy = sum(r.taken for r in out if r.doc_id % 2)
    assert heavy > 0.95 * sum(r.taken for r in out)


# ---------------------------------------------------------------- 5

def test_remove_repeats(spark):
    rng = random.Random(2)
    passage, other = sentence(rng, 70), sentence(rng, 25)
    rows = [(0, None), (1, ""), (2, "a " * 45), (3, "b " * 19)]
    for i in range(4, 60):
        w = sentence(rng, rng.randint(0, 90), 10 ** 6)
        at = rng.randint(0, len(w))
        part = rng.choice((passage, other, passage[10:40], passage[:35], []))
        rows.append((i, "  ".join(w[:at] + part + w[at:]) + "\n"))
    rows += [(100, rows[20][1]), (90, rows[20][1]), (200, "x y " * 3000)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(documents(spark, rows)).collect()}
    assert got == brute.remove_repeats(rows)


def test_repeated_paths_name_an_earlier_place(spark):
    rng = random.Random(4)
    shared = sentence(rng, 60)
    rows = [(1, " ".join(sentence(rng, 30, 10**6) + shared)), (2, " ".join(shared + sentence(rng, 30, 10**6)))]
    (path,) = debruijn.repeated_paths(documents(spark, rows)).collect()
    assert (path.doc_id, path.begin, path.n, path.source_doc, path.source_begin) == (2, 0, 41, 1, 30)


def test_remove_repeats_of_repeated_rows(spark):
    text = " ".join(sentence(random.Random(1), 30))
    rows = [(5, text), (5, text), (None, text)]
    got = sorted((r.doc_id or 99, r.n_removed) for r in debruijn.remove_repeats(documents(spark, rows)).collect())
    assert got == [(5, 0), (5, 0), (99, 30)]
    assert debruijn.remove_repeats(documents(spark, [])).count() == 0


def test_windows_of_a_common_phrase_spread_over_parts(spark, monkeypatch):
    rng = random.Random(14)
    phrases = [sentence(rng, debruijn.GRAM) for _ in range(3000)]
    w = words.split_words(*words.text_bytes(pa.array([" ".join(p) for p in phrases])), words.SPACE_WORDS)
    phrase = phrases[int(np.argmin(words.window_hashes(w.hashes(), debruijn.GRAM)[::debruijn.GRAM]))]
    rows = [(i, " ".join(sentence(rng, 14, 10**6) + phrase + sentence(rng, 14, 10**6))) for i in range(2000)]
    rows += [(2000 + i, " ".join(sentence(rng, 100, 10**6))) for i in range(100)]
    docs = documents(spark, rows + [(3000, rows[7][1])])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(docs).collect()}
    assert got == brute.remove_repeats(rows + [(3000, rows[7][1])]) and got[3000][1] == 34

    def counted(batches):                                 # one path per partition: its number of windows
        n = sum(len(b.column(b.schema.get_field_index("edge")).flatten()) for b in batches)
        one = [pa.array([n], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays(one, ["doc_id", "tag", "begin", "n", "source_doc", "source_begin"])

    monkeypatch.setattr(debruijn, "_sources", counted)
    loads = [r.doc_id for r in debruijn.repeated_paths(docs).select("doc_id").collect()]
    assert max(loads) < 0.5 * 15 * 2000                   # of the phrase's windows, most were in one


# ---------------------------------------------------------------- 6

def test_top_k(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, [0.5] * 6) for i in range(100)]                                # ties
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (420, [1.0] * 3), (421, [-1.0] * 3), (440, [0.0] * 6), (7, [0.9] * 6)]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {tuple(r) for r in topk.top_k(df, 10, 20).collect()}
    assert got == brute.top_k(rows, 10, 20)
    assert topk.top_k(df.where("false"), 10, 20).count() == 0


def test_top_k_of_a_query_with_many_rows_of_its_own(spark):
    rng = random.Random(13)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(1, 100)]
    rows += [(100, [5 + n / 1024] + [4.0] * 5) for n in range(15)]                    # more than k, best by far
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = topk.top_k(df, 10, 20).collect()
    want = brute.top_k(rows, 10, 20)
    assert {tuple(r) for r in got} == want
    assert sum(q == 100 for q, *_ in want) >= 10


@pytest.mark.parametrize("largest", (2.0 ** 10, 2.0 ** 10 - 1 / 1024, 2.0 ** 17, 3e5))
def test_top_k_of_large_components(spark, largest):
    """At 2^20 after scaling and above, some so large that double precision would tie what differs."""
    rng = random.Random(14)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(1, 80)]
    rows += [(100 + i, [largest, largest + i / 1024, *(rng.uniform(-1, 1) for _ in range(3))]) for i in range(40)]
    rows += [(200, [-largest] * 5), (20, [largest] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert {tuple(r) for r in topk.top_k(df, 10, 20).collect()} == brute.top_k(rows, 10, 20)


def test_scores_beyond_a_long_are_refused(spark):
    df = spark.createDataFrame([(0, [1e13, 1.0]), (1, [1e13, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds 64 bits"):
        topk.top_k(df, 10, 20).collect()
    with pytest.raises(Exception, match="exceeds 64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e300])], "vec_id long, embedding array<double>"), 10, 20).collect()


def test_top_k_broadcasts_nothing(spark):
    """What goes to every slot is larger than the queries that it is estimated by: at 200 partitions, 200 times."""
    df = spark.createDataFrame([(i, [i % 7 / 8, 1.0]) for i in range(200)], "vec_id long, embedding array<double>")
    plan = topk.top_k(df, 10, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan


def test_top_k_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(topk, "HELD", 100)
    rng = random.Random(15)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4 + i % 2)]) for i in range(500)]
    rows += [(500 + i, [0.5] * 4) for i in range(60)] + [(n % 3 * 20, [0.25 * n] * 4) for n in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(14)
    assert {tuple(r) for r in topk.top_k(df, 10, 20).collect()} == brute.top_k(rows, 10, 20)


def test_cells_bound_what_is_sent_and_held():
    for tasks, blocks, candidates, queries in itertools.product((1, 12, 600), (0, 1, 155, 10 ** 6), (0, 10 ** 4, 10 ** 9),
                                                                (0, 10 ** 4, 10 ** 7, 10 ** 9)):
        groups, slots = topk.cells(tasks, blocks, candidates, queries)
        assert groups >= 1 and queries <= groups * topk.HELD
        assert slots == 1 or slots * queries <= groups * candidates and groups * slots <= tasks and slots <= blocks


def test_contending_holds_the_best():
    rng = np.random.default_rng(1)
    for parts in (1, 2, 3):
        for _ in range(30):
            lists = rng.integers(-50, 50, (parts, 7, 200)).astype(float)
            lists[:, rng.random((7, 200)) < 0.1] = -np.inf                            # own rows
            lists[:, 3] = -np.inf
            total = lists.sum(0)
            least = np.sort(total, 1)[:, -5] + rng.integers(-3, 3, 7)
            least[3] = 4
            got = set(zip(*(v.tolist() for v in topk.contending(lists, least, 5))))
            assert set(zip(*(v.tolist() for v in np.nonzero(total >= least[:, None])))) <= got
            assert not any(np.isneginf(total[at]) for at in got)


def test_contenders_hold_the_best():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lists = rng.integers(-50, 50, (2, 500)).astype(float)
        total = lists.sum(0)
        left = topk.contenders(lists, -np.inf, 5)
        assert set(np.flatnonzero(total >= np.sort(total)[-5]).tolist()) <= set(left.tolist())


# ---------------------------------------------------------------- 7

@pytest.fixture(scope="module")
def tok():
    with open(chat.TOKENIZER, encoding="utf-8") as f:
        return chat.tokenizer(f.read())


PIECES = st.lists(st.one_of(st.sampled_from(["<", "|", "[", "\\", "/s>", "s>", "INST]", "[/INST]", "<<SYS>>", "SYS>>",
                                             "<|turn|>", "<|end|>\n", "<|text|>", "<|endoftext|>", " ", "\n", "é", "😀"]),
                            st.text(st.characters(exclude_categories=["Cs"]), max_size=4)), max_size=12).map("".join)


def test_chat_round_trip_and_mask(tok):
    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PIECES), PIECES), max_size=5))
    def holds(turns):
        text, spans = chat.render(turns)
        assert chat.read_back(text) == turns
        enc = tok.encode(text, add_special_tokens=False)
        offs = np.array(enc.offsets, np.int32).reshape(-1, 2)
        in_loss = chat.mask(offs[:, 0], offs[:, 1], spans)
        got = "".join(chat.masked_texts(text, offs[:, 0], offs[:, 1], in_loss))
        assert got == "".join(t for r, t in turns if r == chat.LOSS_ROLE)
    holds()


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"),
            (None, 0, "user", "x"), (2, None, "assistant", "z"), (2, 0, "user", "y")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[2].n_turns, got[None].loss_chars) == (4, 2, 2, 0)
    text = {r.conv_id: r.formatted for r in chat.format_chats(df).collect()}
    assert chat.read_back(text[2]) == [("assistant", "z"), ("user", "y")]
    assert chat.read_back(text[1]) == [("", "q"), ("assistant", ""), ("assistant", "a"), ("assistant", "a")]
    assert chat.format_chats(df.where("false")).count() == 0


# ---------------------------------------------------------------- 8

def test_personal_data(spark):
    rng = random.Random(7)
    bits = ["@", ".", "+", "-", " ", "(", ")", "1", "2", "4111 1111 1111 1111", "192.168.1.1", "a", "b.c", "x@y.z", "_",
            "é", "\n", "0", "9", "255", "256", "+1 (443) 555-5793", "4111111111111111", "+44", "😀"]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "12345.1.1.1", "000255.1.1.1 256.1.1.1", "+1" + " " * 50 + "2345678901",
             "1" * 2000, "1 " * 2000, "a" * 2000 + "@", "1.1.1.1 " * 700]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(None, "mail x@y.z"), (3, "1.2.3.4")]
    found = pii.summary(pii.personal_data(documents(spark, rows)))
    want = Counter((i, *brute.personal_data(t)[0]) for i, t in rows)
    assert Counter(tuple(r)[:6] for r in found.collect()) == want
    assert not re.search("Python|Arrow|Pandas", found._jdf.queryExecution().toString())
    assert pii.summary(pii.personal_data(documents(spark, []))).count() == 0


def test_base_spans_stay_and_long_runs_are_linear(spark):
    rows = [(1, "call (443) 555-5793 or write x@y.org " * 50), (2, "9" * 400000), (3, "a" * 400000 + "@"), (4, "+1" * 100000)]
    got = {r.doc_id: r for r in pii.personal_data(documents(spark, rows)).collect()}
    base = [(s.begin, s.kind, s.end) for s in got[1].spans if s.base]
    assert len(base) == 50 and all(s.base or s.score >= pii.ACCEPT for s in got[1].spans)
    assert not any(got[i].spans for i in (2, 3, 4))


def test_em_learns_which_labelers_to_trust():
    counts = {0b00000: 500, 0b10000: 300, 0b01111: 200, 0b11111: 250, 0b00100: 40}
    p = pii.reliabilities(counts)
    assert p[0b01111] > 0.95 and p[0b11111] > 0.95 and p[0] < 0.05 and p[0b10000] < 0.1
    w = pii.train(counts, p)
    z = lambda v: w[0] + sum(a for j, a in enumerate(w[1:]) if v >> j & 1)
    assert z(0b11111) > 0 > z(0b10000)


# ---------------------------------------------------------------- 9

def test_quality_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    held = out.join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_quality_edge_cases(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "a b c"), (None, "x"), (3, "other"), (4, "w " * 30000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, 1), (2, None), (None, 0), (1, 7)], "doc_id long, quality int")
    rows = quality.classify(docs, one).collect()
    assert len(rows) == 6 and len({r.score for r in rows}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(documents(spark, []), one).count() == 0
    crc = spark.sql("SELECT crc32('3') % 5 = 0").first()[0]
    assert {r.held_out for r in rows if r.doc_id == 3} == {crc} and {r.held_out for r in rows if r.doc_id is None} == {False}


def test_forest_walk_equals_node_by_node():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = quality.train(x, y, 30)
    for row, score in zip(x[:50], forest.scores(x[:50])):
        margin = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if f[node] >= 0 and row[f[node]] > t[node] else 1)
            margin += v[node - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-margin)))
    assert ((forest.scores(x) >= 0.5) == y).mean() > 0.97


# ---------------------------------------------------------------- 10

def shards(spark, rows):
    return sharding.shard(documents(spark, rows), 8).collect()


def test_sharding(spark):
    rng = random.Random(11)
    rows = [(i, f"{i}" + "é" * rng.randint(0, 300)) for i in range(3000)] + [(i, "hot text") for i in range(3000, 4500)]
    rows += [(4600, None), (4601, None), (None, "n"), (7, "twice"), (7, "twice"), (4602, "long " * 1500)]
    out = shards(spark, rows)
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    load, slots, where = Counter(), {}, {}
    sizes = Counter((i, len((t or "").encode()) + 16) for i, t in rows)
    assert Counter((r.doc_id, r.size) for r in out) == sizes
    for r in out:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load.values()) <= 1.02 * min(load.values())
    assert sum(len(s) > 1 for s in where.values()) <= 1      # only the hot group is split


def test_sharding_edge_cases(spark):
    assert shards(spark, []) == []
    assert [(r.size, r.slot, r.text_crc32) for r in shards(spark, [(1, None)])] == [(16, 0, 0)]


def test_shards_stay_together_and_repeat(spark):
    rows = [(i, f"text {i % 500} " * 5) for i in range(2000)]
    one, two = ({(r.doc_id, r.shard, r.slot) for r in shards(spark, x)} for x in (rows, rows[::-1]))
    assert one == two
    of = {i: s for i, s, _ in one}
    assert all(len({of[i] for i in ids}) == 1 for ids in brute.groups(rows).values())
