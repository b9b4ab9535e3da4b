"""Operator 12: near-duplicate embeddings by the epsilon grid order join.

Vectors of cosine c or more lie, scaled to length one, within
eps = sqrt(2 - 2c) of each other.  So:

1. equal vectors become one, with their number of rows; the copies meet again
   only in the last step;
2. the directions of most variance are taken from the second moments of all
   vectors, and every vector gets its coordinates along the ``LEADING`` first
   ones.  Cut into cells of side eps, these give the epsilon grid order: vectors
   are sorted by their cells, one direction after the other, and cut into
   sequences of about ``BLOCK_BYTES``;
3. sequences are joined recursively.  Sixteen neighbours make an interval, sixteen
   of these the next, up to one.  From the top down, each pair of intervals
   is replaced by the pairs of their parts, and a pair whose boxes (least and
   greatest coordinates along the leading directions) are more than eps apart is
   skipped with all below it: projections never lengthen a distance;
4. the pairs of sequences that are left are joined in numpy, again cut into pieces
   that are skipped by their boxes; what remains is multiplied in double
   precision, and products within ``ROUNDING`` of c are decided by the exact sums;
5. a task reports the number of links of each vector and edges that span its
   components, never the links themselves; components follow from the edges.

The join is exact: a skipped pair cannot be a link.  Where the leading directions
hold little of the variance few blocks are skipped, and the work is the square
of the number of different vectors; memory stays at two sequences a task.

Only vectors of equal length are compared.  Vectors that are null, empty, zero, or
hold null or non-finite components link with nothing and are components of their
own; so are rows without vec_id, whose component is null.  Rows that repeat a
vec_id are vectors of their own and named alike.  Equal vectors are linked with
each other; 0.0 and -0.0 are equal.  Other columns are ignored.  An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .tables import map_batches, n_partitions, saved, spread_join

COSINE = 0.95
LEADING = 8
BLOCK_BYTES = 2 << 20
PIECE = 256
#: Products this close to the threshold are summed exactly.
ROUNDING = 1e-9
#: Boxes are widened by this much, for rounding in the projections.
SLACK = 1e-7
FAN_OUT = 4  # bits: sixteen intervals make the next


def _matrix(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list column as values, offsets from 0, and lengths."""
    column = batch.column(batch.schema.get_field_index(name))
    at = column.offsets.to_numpy()
    values = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    return values, at - at[0], np.where(np.asarray(column.is_valid()), np.diff(at), 0)


def _of_length(values: np.ndarray, at: np.ndarray, rows: np.ndarray, dim: int) -> np.ndarray:
    return values[at[rows][:, None] + np.arange(dim)]


def _named(batch: pa.RecordBatch):
    """Each row with a 128-bit name of its vector; null if it takes no part."""
    ids = batch.column(0)
    x, at, sizes = _matrix(batch, "x")
    x = x.astype(np.float64) + 0.0                                  # null reads as nan, -0.0 becomes 0.0
    names: list = [None] * len(sizes)
    known = np.asarray(ids.is_valid())
    for i in np.flatnonzero((sizes > 0) & known).tolist():
        v = x[at[i]:at[i] + sizes[i]]
        if np.isfinite(v).all() and v.any():
            names[i] = hashlib.blake2b(v.tobytes(), digest_size=16).digest()
    yield {"vec_id": ids, "name": pa.array(names, pa.binary()), "x": W.lists(x, np.append(at, len(x))[:len(at)], pa.float64())}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)                         # no overflow, whatever the length
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components, of all vectors of a task by length; the upper triangle."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        x, at, sizes = _matrix(batch, "x")
        for dim in np.unique(sizes).tolist():
            u = _unit(_of_length(x, at, np.flatnonzero(sizes == dim), dim))
            sums[dim] = sums.get(dim, 0) + u.T @ u
    for dim, m in sums.items():
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i, pa.int32()),
                                          pa.array(j, pa.int32()), pa.array(m[i, j])], ["dim", "i", "j", "s"])


def _directions(t: pa.Table) -> pa.Table:
    """The leading principal directions of the vectors of one length, end to end."""
    dim = t.column("dim")[0].as_py()
    m = np.zeros((dim, dim))
    i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
    m[i, j] = m[j, i] = t.column("s").to_numpy()
    axes = np.linalg.eigh(m)[1][:, ::-1][:, :LEADING]
    flat = np.ascontiguousarray(axes.T).ravel()
    return pa.table({"dim": pa.array([dim], pa.int32()), "axes": W.lists(flat, np.array([0, len(flat)]), pa.float64())})


def _placed(eps: float):
    """Unit vectors, their leading coordinates (missing ones 0) and grid cells."""
    def run(batch: pa.RecordBatch):
        x, at, sizes = _matrix(batch, "x")
        axes, of, _ = _matrix(batch, "axes")
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            u = _unit(_of_length(x, at, rows, dim))
            lead = min(dim, LEADING)
            y = np.zeros((len(rows), LEADING))
            y[:, :lead] = u @ axes[of[rows[0]]:of[rows[0] + 1]].reshape(lead, dim).T
            cells, place = np.floor(y / eps).astype(np.int32), np.arange(len(rows) + 1)
            take = pa.array(rows)
            yield {"dim": pa.array(np.full(len(rows), dim, np.int32)), "name": get("name").take(take),
                   "n": get("n").take(take), "least": get("least").take(take),
                   "u": W.lists(u.ravel(), place * dim, pa.float64()), "y": W.lists(y.ravel(), place * LEADING, pa.float64()),
                   "cells": W.lists(cells.ravel(), place * LEADING, pa.int32())}
    return run


_PLACED = "dim int, name binary, n long, least long, u array<double>, y array<double>, cells array<int>"
_BLOCK = ("dim int, part int, place int, nodes array<long>, names array<binary>, n array<long>, least array<long>, "
          "u array<double>, y array<double>, lo array<double>, hi array<double>")


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted vectors as sequences of one length and about BLOCK_BYTES."""
    part, place, rows, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

    def packed() -> pa.RecordBatch:
        nonlocal place, rows
        t = pa.Table.from_batches(held)
        n, dim = t.num_rows, t.column("dim")[0].as_py()
        flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy()
        one = lambda v, kind: W.lists(v, np.array([0, len(v)]), kind)
        y = flat("y").reshape(n, LEADING)
        names = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), t.column("name").combine_chunks().cast(pa.binary()))
        nodes = (part << 33) + rows + np.arange(n)
        out = pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([place], pa.int32()), one(nodes, pa.int64()),
             names, one(t.column("n").to_numpy(), pa.int64()), one(t.column("least").to_numpy(), pa.int64()),
             one(flat("u"), pa.float64()), one(y.ravel(), pa.float64()), one(y.min(0), pa.float64()),
             one(y.max(0), pa.float64())],
            ["dim", "part", "place", "nodes", "names", "n", "least", "u", "y", "lo", "hi"])
        place, rows = place + 1, rows + n
        held.clear()
        return out

    for batch in batches:
        dims = batch.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(dims[1:] != dims[:-1]) + 1, len(dims)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != dims[a]:
                yield packed()
                size = 0
            most = max(PIECE, BLOCK_BYTES // (8 * int(dims[a])))
            while a < b:
                take = min(b - a, most - size)
                held.append(batch.slice(a, take))
                a, size = a + take, size + take
                if size == most:
                    yield packed()
                    size = 0
    if held:
        yield packed()


def _apart(a: str, b: str) -> Column:
    """Square of the least distance of two boxes."""
    gaps = (F.greatest(F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.lit(0.0))
            for k in range(LEADING))
    return reduce(lambda x, y: x + y, (g * g for g in gaps))


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of sequences whose boxes come within eps."""
    boxes = [F.col(f"{s}")[k].alias(f"{s}{k}") for s in ("lo", "hi") for k in range(LEADING)]
    most = blocks.agg(F.max("place"), F.max("part")).first()
    if most[0] is None:
        return blocks.sparkSession.createDataFrame([], "dim int, a long, b long, bits int")
    bits = -(-int(most[0]).bit_length() // FAN_OUT) * FAN_OUT      # a partition's sequences fill whole intervals
    node = saved(blocks.select("dim", _sequence(bits).alias("s"), *boxes), "boxes")
    top = -(-((int(most[1]) << bits) + int(most[0])).bit_length() // FAN_OUT)
    levels = [node]
    for _ in range(top):
        levels.append(saved(levels[-1].groupBy("dim", F.shiftright("s", FAN_OUT).alias("s"))
                            .agg(*(F.min(f"lo{k}").alias(f"lo{k}") for k in range(LEADING)),
                                 *(F.max(f"hi{k}").alias(f"hi{k}") for k in range(LEADING))), "boxes"))
    pairs = levels[-1].select("dim", F.col("s").alias("a"), F.col("s").alias("b"))
    for level in levels[-2::-1]:
        parts = level.withColumn("up", F.shiftright("s", FAN_OUT))
        pairs = saved(pairs.alias("p")
                      .join(parts.alias("x"), F.expr("p.dim = x.dim AND p.a = x.up"))
                      .join(parts.alias("y"), F.expr("p.dim = y.dim AND p.b = y.up"))
                      .where("x.s <= y.s").where(_apart("x", "y") <= (eps + SLACK) ** 2)
                      .select("p.dim", F.col("x.s").alias("a"), F.col("y.s").alias("b")), "pairs")
    return pairs.withColumn("bits", F.lit(bits))


def _sequence(bits: int | Column) -> Column:
    return F.shiftleft(F.col("part").cast("long"), bits) + F.col("place")


def _components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node each can reach."""
    nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
    a, b = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label, new.copy())                       # a label's own node follows
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _linked(u: np.ndarray, v: np.ndarray, cosine: float) -> np.ndarray:
    p = u @ v.T
    out = p >= cosine
    for i, j in zip(*np.nonzero(np.abs(p - cosine) <= ROUNDING)):
        a, b = u[i].tolist(), v[j].tolist()
        out[i, j] = math.fsum(x * y for x, y in zip(a, b)) >= cosine * math.sqrt(
            math.fsum(x * x for x in a) * math.fsum(x * x for x in b))
    return out


def _join(cosine: float, eps: float):
    """Links of two sequences: counts, as (node, null, n), and spanning edges, as (node, other, 0)."""
    def run(batch: pa.RecordBatch):
        get = lambda c, i: batch.column(batch.schema.get_field_index(c))[i]
        for row in range(batch.num_rows):
            dim, own = get("dim", row).as_py(), get("a", row).as_py() == get("b", row).as_py()
            side = []
            for s in "xy":
                nodes, n = get(f"{s}_nodes", row).values.to_numpy(), get(f"{s}_n", row).values.to_numpy()
                side.append((nodes, n, get(f"{s}_u", row).values.to_numpy().reshape(-1, dim),
                             get(f"{s}_y", row).values.to_numpy().reshape(-1, LEADING)))
            (xn, xw, xu, xy), (yn, yw, yu, yy) = side
            x_links, y_links, edges = np.zeros(len(xn), np.int64), np.zeros(len(yn), np.int64), []
            boxes = [[(y[k:k + PIECE].min(0), y[k:k + PIECE].max(0)) for k in range(0, len(y), PIECE)] for y in (xy, yy)]
            for i, (lo, hi) in enumerate(boxes[0]):
                for j, (lo2, hi2) in enumerate(boxes[1]):
                    if own and j < i:
                        continue
                    gap = np.maximum(0, np.maximum(lo - hi2, lo2 - hi))
                    if (gap * gap).sum() > (eps + SLACK) ** 2:
                        continue
                    a, b = slice(i * PIECE, (i + 1) * PIECE), slice(j * PIECE, (j + 1) * PIECE)
                    hit = _linked(xu[a], yu[b], cosine)
                    if own and i == j:
                        np.fill_diagonal(hit, False)
                    if not hit.any():
                        continue
                    x_links[a] += hit @ yw[b]
                    if not (own and i == j):
                        y_links[b] += xw[a] @ hit
                    p, q = np.nonzero(hit)
                    edges.append(_components(xn[a][p], yn[b][q]))
            if edges:
                node, to = _components(*(np.concatenate(e) for e in zip(*edges)))
                far = node != to
                both, links = np.r_[xn, yn], np.r_[x_links, y_links]
                some = links > 0
                k = int(some.sum())
                yield {"node": pa.array(np.r_[both[some], node[far]]),
                       "other": pa.array(np.r_[np.zeros(k, np.int64), to[far]], mask=np.r_[np.ones(k, bool), ~far[far]]),
                       "links": pa.array(np.r_[links[some], np.zeros(far.sum(), np.int64)])}
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of
    ``vectors(vec_id, embedding)``."""
    spark, eps = vectors.sparkSession, math.sqrt(2 - 2 * cosine)
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = saved(map_batches(every, _named, "vec_id long, name binary, x array<double>"), "vectors")

    # Equal vectors: one of each deal first, so a hot vector is gathered as few rows.
    deal = F.pmod(F.xxhash64("vec_id"), F.lit(n_partitions(spark)))
    dealt = (rows.where("name IS NOT NULL").groupBy("name", deal.alias("deal"))
             .agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("x").alias("x")))
    classes = saved(dealt.groupBy("name").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.first("x").alias("x")),
                    "classes")

    moments = (classes.select("x").mapInArrow(_moments, "dim int, i int, j int, s double")
               .groupBy("dim", "i", "j").agg(F.sum("s").alias("s")))
    axes = saved(moments.groupBy("dim").applyInArrow(_directions, "dim int, axes array<double>"), "axes")
    placed = saved(map_batches(classes.withColumn("dim", F.size("x")).join(axes, "dim").select("name", "n", "least", "x", "axes"),
                               _placed(eps), _PLACED), "placed")
    order = ["dim", *(F.col("cells")[k] for k in range(LEADING)), "name"]
    blocks = saved(placed.repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order)
                   .mapInArrow(_sequences, _BLOCK), "sequences")

    pairs = _pairs(blocks, eps)
    # Either side may be the first, so that all sequences are sent about equally often.
    swap = F.expr("(a + b) % 2 = 1")
    pairs = pairs.select("dim", "bits", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
                         F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))

    def sides(name: str, s: str) -> DataFrame:
        return blocks.select(F.col("part").alias(f"{s}_part"), F.col("place").alias(f"{s}_place"),
                             *(F.col(c).alias(f"{s}_{c}") for c in ("nodes", "n", "u", "y")))

    def at(key: str, s: str) -> Column:
        return ((F.expr(f"shiftright({key}, bits)").cast("int") == F.col(f"{s}_part"))
                & (F.expr(f"{key} - shiftleft(shiftright({key}, bits), bits)").cast("int") == F.col(f"{s}_place")))

    joined = pairs.join(sides("a", "x"), at("a", "x")).join(sides("b", "y"), at("b", "y"))
    found = saved(map_batches(joined.select("dim", "a", "b", *(f"{s}_{c}" for s in "xy" for c in ("nodes", "n", "u", "y"))),
                              _join(cosine, eps), "node long, other long, links long"), "links")
    links = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))

    # Back to rows, by way of each different vector.
    members = blocks.select(F.explode(F.arrays_zip("nodes", "names", "n", "least")).alias("m")).select(
        F.col("m.nodes").alias("node"), F.col("m.names").alias("name"), F.col("m.n").alias("n"), F.col("m.least").alias("least"))
    members = saved(members.join(reached, "node", "left").join(links, "node", "left")
                    .select("name", F.coalesce("component", "node").alias("component"), "least",
                            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "members")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    judged = saved(spread_join(members, smallest, ["component"], F.col("name")).select("name", "n_links", "component_id"),
                   "judged")
    out = spread_join(rows.select("vec_id", "name"), judged, ["name"], F.col("vec_id"))
    alone = F.when(F.col("name").isNull(), F.col("vec_id"))
    return (out.withColumn("component_id", F.coalesce("component_id", alone))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                    F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")))
