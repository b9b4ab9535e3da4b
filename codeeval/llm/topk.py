"""Operator 6: exact top-k by inner product with no random access.

Vectors become integers, floor(1024 * x) of each component.  A vector is cut in
``PARTS`` parts; for a query, each part gives one list of the candidates of a
block, sorted by the inner product of that part, and a candidate's score is the
sum over its lists.  The lists are read from the top, all to the same depth.
What is read gives every candidate a lower bound (for an unread part the least
value of its list) and an upper bound (for an unread part the value reached);
a candidate whose upper bound is below the k-th best lower bound cannot
qualify.  The depth doubles until few candidates can, and their final scores
are resolved from all their lists.  Blocks of one task share the best scores so
far: once a query has k of them, its lists are read only until the values
reached sum to the k-th, for 64 queries at once.

Queries meet candidates in cells, one task each: candidate blocks are dealt to
slots and query blocks to groups, and a cell gets the blocks of a slot and of a
group.  Both are sent by a shuffle, never broadcast, and the queries of a cell
are read first, so a task holds them and one block of candidates.  The copies of
the queries that travel amount to those of the candidates at most.  Each cell
reports k rows a query, and those are ranked.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without vec_id.  Only vectors of equal length are compared.
A query's own rows are all rows with its vec_id; they are left out before any
bound is taken.  Equal candidate rows each
take a rank; equal query rows give one list.  Ties go to the smaller vec_id.
Other columns are ignored.

Sums of double precision are exact while components stay below ``LIMIT`` after
scaling.  Vectors with larger ones travel in blocks of their own, of 64-bit integers;
where such a block and a query could sum to 2^53 or more, scores are summed as Python
integers, without lists.  Components of 2^63 and scores that a long cannot hold are
refused with an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, n_partitions, saved

SCALE = 1024
PARTS = 2
BLOCK = 4096
QUERIES = 1024
LIMIT = 1 << 20
#: Components of the queries that a cell holds, with 2k for the results of each.
HELD = 1 << 22
#: Candidate blocks of a slot: those after the first are met with scores to reach.
SHARE = 4


def _blocks(batch: pa.RecordBatch):
    """Rows as blocks of vectors of one length."""
    ids, vectors = batch.column(0), batch.column(1)
    sizes = np.where(np.asarray(vectors.is_valid()), np.diff(vectors.offsets.to_numpy()), 0)
    flat = vectors.values.slice(vectors.offsets[0].as_py(), vectors.offsets[-1].as_py() - vectors.offsets[0].as_py())
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)     # a null component reads as nan
    at = vectors.offsets.to_numpy()[:-1] - vectors.offsets[0].as_py()
    known = np.asarray(ids.is_valid())
    for dim in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero((sizes == dim) & known)
        m = np.floor(SCALE * x[at[rows][:, None] + np.arange(dim)])
        good = np.isfinite(m).all(1)
        rows, m = rows[good], m[good]
        if (np.abs(m) >= 2.0 ** 63).any():
            raise ValueError("a component exceeds 64 bits after scaling")
        large = (np.abs(m) >= LIMIT).any(1)
        for wide in (False, True):
            of = np.flatnonzero(large == wide)
            for a in range(0, len(of), BLOCK):
                some, part = rows[of[a:a + BLOCK]], m[of[a:a + BLOCK]].astype(np.int64)
                yield {"dim": pa.array([dim], pa.int32()), "ids": _row(ids.take(pa.array(some)).to_numpy(), pa.int64()),
                       **_either(part.ravel(), np.array([0, part.size]), wide)}


def _either(values: np.ndarray, first: np.ndarray, wide: bool) -> dict:
    """Components as column ``m`` or, of vectors with large ones, as ``wide``; the other is null."""
    kinds = {"m": pa.int32(), "wide": pa.int64()}
    own = "wide" if wide else "m"
    return {c: W.lists(values.astype(kinds[c].to_pandas_dtype()), first, kinds[c]) if c == own
            else pa.nulls(len(first) - 1, pa.list_(kinds[c])) for c in kinds}


def _components(m, wide) -> np.ndarray:
    return (m if m.is_valid else wide).values.to_numpy()


def _row(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return W.lists(values, np.array([0, len(values)]), kind)


_BLOCKS = "dim int, ids array<long>, m array<int>, wide array<long>"
_QUERIES = "dim int, ids array<long>, numbers array<long>, m array<int>, wide array<long>"


def _chosen(every: int):
    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            dim, ids = batch.column(0)[i].as_py(), batch.column(1)[i].values.to_numpy()
            wide = not batch.column(2)[i].is_valid
            m = _components(batch.column(2)[i], batch.column(3)[i]).reshape(-1, dim)
            some = np.flatnonzero(ids % every == 0)
            yield {"dim": pa.array(np.full(len(some), dim, np.int32)), "id": pa.array(ids[some]),
                   **_either(m[some].ravel(), np.arange(len(some) + 1) * dim, wide)}
    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbered query rows as blocks of queries."""
    for batch in batches:
        dims, large = batch.column(0).to_numpy(), np.asarray(batch.column(3).is_valid())
        for dim, wide in {(d, w) for d, w in zip(dims.tolist(), large.tolist())}:
            rows = np.flatnonzero((dims == dim) & (large == wide))
            for a in range(0, len(rows), QUERIES):
                part = batch.take(pa.array(rows[a:a + QUERIES]))
                flat = part.column(3 if wide else 2).flatten().to_numpy()
                of = _either(flat, np.array([0, len(flat)]), wide)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), _row(part.column(1).to_numpy(), pa.int64()),
                     _row(part.column(4).to_numpy(), pa.int64()), of["m"], of["wide"]],
                    ["dim", "ids", "numbers", "m", "wide"])


def cells(tasks: int, blocks: int, candidates: int, queries: int) -> tuple[int, int]:
    """Groups and slots for so many candidate blocks, components of candidates and, with results, of queries."""
    groups = max(1, -(-queries // HELD), math.isqrt(tasks * queries // (4 * max(1, candidates))))
    return groups, max(1, min(tasks // groups, -(-blocks // SHARE), groups * candidates // max(1, queries)))


def contenders(lists: np.ndarray, least: float, k: int) -> np.ndarray:
    """Candidates that may be among the best ``k`` and score ``least`` or more;
    ``lists``: (parts, candidates) scores by part, without the query's own rows."""
    n = lists.shape[1]
    if n <= 4 * k:
        return np.arange(n)
    falling = np.sort(lists, 1)[:, ::-1]
    depth = 2 * k
    while True:
        front = falling[:, min(depth, n) - 1]                       # value reached in each list
        read = lists >= front[:, None]
        low = np.where(read, lists, falling[:, -1:]).sum(0)
        high = np.where(read, lists, front[:, None]).sum(0)
        least = max(least, np.partition(low, n - k)[n - k])
        left = np.flatnonzero(high >= least)
        if len(left) <= 4 * k or depth >= n:
            return left
        depth *= 2


def contending(lists: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and candidates, as pairs, that may reach the query's ``least``; ``lists``:
    (parts, queries, candidates), own rows at -inf.  The lists of a query are read as far down
    from their tops until the values reached sum to ``least``, which what is read in no list
    cannot reach."""
    front = lists.max(2)
    with np.errstate(invalid="ignore"):                         # tops of own rows only: nothing is read
        front[:-1] = np.floor(front - (front.sum(0) - least) / len(front))[:-1]     # integers, as scores are
    front[-1] = least - front[:-1].sum(0)
    read = lists[0] >= front[0, :, None]
    for part, value in zip(lists[1:], front[1:]):
        read |= part >= value[:, None]
    j, c = np.nonzero(read)
    high = np.maximum(lists[:, j, c], front[:, j]).sum(0)
    left = (high >= least[j]) & (lists[0, j, c] > -np.inf)
    return j[left], c[left]


def _first(lists: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same where a query may have fewer than ``k`` scores yet."""
    found = []
    for j in range(lists.shape[1]):
        others = np.flatnonzero(lists[0, j] > -np.inf)
        found.append(others[contenders(lists[:, j, others], least[j], k)])
    return np.repeat(np.arange(len(found)), [len(c) for c in found]), np.concatenate(found)


class _Held:
    """A block of queries and its best so far: ``scores`` and ``found`` in order, a row a
    query, filled up with -inf; or ``exact``, lists of pairs, once scores are Python integers."""

    def __init__(self, dim: int, ids: np.ndarray, numbers: np.ndarray, m: np.ndarray, k: int):
        self.dim, self.ids, self.numbers, self.m, self.k = dim, ids.copy(), numbers.copy(), m.copy(), k
        self.most = float(np.abs(m.astype(np.float64)).max(initial=0))
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact: list[list[tuple[int, int]]] | None = None

    def _pairs(self, j: int) -> list[tuple[int, int]]:
        n = int((self.scores[j] > -np.inf).sum())
        return list(zip((int(v) for v in self.scores[j, :n]), self.found[j, :n].tolist()))

    def meet(self, c_ids: np.ndarray, x: np.ndarray, most: float) -> None:
        """Add the candidates of a block."""
        large = self.dim * most * self.most >= 2.0 ** 53        # double precision cannot hold these products
        if large and self.exact is None:
            self.exact = [self._pairs(j) for j in range(len(self.ids))]
        if self.exact is None:
            x = x.astype(np.float64)
            for a in range(0, len(self.ids), 64):
                some, at = slice(a, a + 64), 0
                while at < len(x):
                    known = (self.scores[some, -1] > -np.inf).all()
                    # a few first: the sooner k scores are known, the less is read
                    to = at + ((8 * at or len(x)) if known else max(at, 4 * self.k))
                    self._meet(some, c_ids[at:to], x[at:to], contending if known else _first)
                    at = to
            return
        x = x.astype(object if large else np.float64)
        for j, (q_id, q) in enumerate(zip(self.ids.tolist(), self.m)):
            others = c_ids != q_id
            scores = (int(v) for v in (x[others] @ q.astype(x.dtype)).tolist())
            self.exact[j] = sorted([*self.exact[j], *zip(scores, c_ids[others].tolist())], key=lambda c: (-c[0], c[1]))[:self.k]

    def _meet(self, some: slice, c_ids: np.ndarray, x: np.ndarray, chosen) -> None:
        q_ids, qs = self.ids[some], self.m[some].astype(np.float64)
        cut = np.unique(np.linspace(0, self.dim, PARTS + 1).astype(int))
        lists = np.empty((len(cut) - 1, len(qs), len(x)))
        for part, lo, hi in zip(lists, cut[:-1], cut[1:]):
            np.matmul(qs[:, lo:hi], x[:, lo:hi].T, out=part)
        own = q_ids[:, None] == c_ids
        if own.any():
            lists[:, own] = -np.inf                             # own rows set no bound
        least = self.scores[some, -1]
        j, c = chosen(lists, least, self.k)
        score, last = lists[:, j, c].sum(0), self.found[some, -1]
        left = np.flatnonzero((score > least[j]) | (score == least[j]) & (c_ids[c] < last[j]))
        if len(left):
            n = np.arange(len(q_ids))
            j, s, ids = (np.concatenate(both) for both in (
                (np.repeat(n, self.k), j[left]), (self.scores[some].ravel(), score[left]),
                (self.found[some].ravel(), c_ids[c[left]])))
            o = np.lexsort((ids, -s, j))
            o = o[np.searchsorted(j[o], n)[:, None] + np.arange(self.k)]
            self.scores[some], self.found[some] = s[o], ids[o]

    def listed(self) -> pa.RecordBatch:
        """Rows ``query_id, number, vec_id, score``."""
        if self.exact is None:
            j, at = np.nonzero(self.scores > -np.inf)
            ids, scores = self.found[j, at], self.scores[j, at].astype(np.int64)
        else:
            j = np.repeat(np.arange(len(self.ids)), [len(c) for c in self.exact])
            every = [c for own in self.exact for c in own]
            for of, (v, _) in zip(j, every):
                if not -2 ** 63 <= v < 2 ** 63:
                    raise OverflowError(f"a score of query {self.ids[of]} exceeds 64 bits")
            ids, scores = np.array([i for _, i in every], np.int64), np.array([v for v, _ in every], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[j]), pa.array(self.numbers[j]), pa.array(ids), pa.array(scores)],
                                          ["query_id", "number", "vec_id", "score"])


def _best(k: int):
    """Over rows in the order of their cells, of each the queries first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            get = lambda name, i: batch.column(batch.schema.get_field_index(name))[i]  # noqa: B023,E731
            for i in range(batch.num_rows):
                if (here := get("cell", i).as_py()) != cell:
                    yield from (q.listed() for q in held)
                    cell, held = here, []
                dim, ids = get("dim", i).as_py(), get("ids", i).values.to_numpy()
                m = _components(get("m", i), get("wide", i)).reshape(-1, dim)
                if get("numbers", i).is_valid:
                    held.append(_Held(dim, ids, get("numbers", i).values.to_numpy(), m, k))
                    continue
                most = float(np.abs(m.astype(np.float64)).max(initial=0))
                for q in held:
                    if q.dim == dim:
                        q.meet(ids, m, most)
        yield from (q.listed() for q in held)
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors(vec_id,
    embedding)`` whose id is divisible by ``every``, the ``k`` best others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    blocks = saved(map_batches(rows, _blocks, _BLOCKS), "blocks")
    tasks = n_partitions(spark)
    chosen = map_batches(blocks, _chosen(every), "dim int, id long, m array<int>, wide array<long>").distinct()
    chosen = chosen.repartition(max(1, tasks // 8), "id").withColumn("number", F.monotonically_increasing_id())
    queries = saved(chosen.mapInArrow(_packed, _QUERIES), "queries")
    size = lambda more: F.coalesce(F.sum((F.col("dim") + F.lit(more).cast("long")) * F.size("ids")), F.lit(0))
    n, candidates = blocks.select(F.count("*"), size(0)).first()
    groups, slots = cells(tasks, n, candidates, queries.select(size(2 * k)).first()[0])
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    sent = queries.select("*", each(slots).alias("slot"), one(groups).alias("group"))
    dealt = blocks.withColumn("numbers", F.lit(None).cast("array<long>")).select(
        *queries.columns, one(slots).alias("slot"), each(groups).alias("group"))
    met = (sent.union(dealt).withColumn("cell", F.col("group") * slots + F.col("slot")).drop("group", "slot")
           .repartitionById(groups * slots, "cell").sortWithinPartitions("cell", F.col("numbers").isNull()))
    near = met.mapInArrow(_best(k), "query_id long, number long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
