"""Operator 5: repeated passages by compacting a de Bruijn graph of token k-mers.

An edge of the graph is a k-mer, a window of ``K`` consecutive words of one
document; two windows with the same words are the same edge.  Every occurrence
of an edge but the first, in the order of (doc_id, word position), has a
source: the coordinate of an earlier occurrence.  Along a document, repeated
edges at consecutive positions whose sources are consecutive as well form a
nonbranching path and are compacted to one row
``(doc_id, begin, n, source_doc, source_begin)``; where the sources part, the
path branches and another row starts.  Consecutive sources mean that all words
of the path stand at the source too.

1. Each window goes to a part chosen by the smallest of its ``GRAM``-word
   hashes, so neighbouring windows mostly travel together, as one run.  Within
   a chunk of texts only the first occurrence of an edge travels; the later
   ones have their source there.  So a passage in a third of all documents is
   one row per chunk, not one per document.
   A phrase that stands in many documents with other words around it gives all
   its windows one part.  So the windows of every part are counted first, and a
   part with more than twice the mean is dealt on by the edge's own hash, to as
   many parts as it holds means.
2. One exchange brings equal edges together, and each part finds the sources.
3. The paths of a document from all parts are joined end to end.
4. Paths are gathered by document and joined with the text, which crosses the
   shuffle compressed.

Edges are compared by 96 bits: the window's 64-bit hash and 32 bits of its
smallest gram's hash.  Documents need not be sorted or unique.

Null, empty and short texts have no windows and stay whole.  Rows that repeat a
doc_id with the same text are the same coordinates, so neither is earlier than
the other; with another text they are told apart by the text and count as
starting at the same place.  A null doc_id comes after all others.  Other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .tables import map_batches, n_partitions, text_of

K = 20
GRAM = 6
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_PATHS = "doc_id long, tag int, begin int, n int, source_doc long, source_begin int"


def _tags(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """16 bits that tell texts of the same doc_id apart."""
    return np.array([int.from_bytes(hashlib.blake2b(buf[a:b], digest_size=2).digest(), "little")
                     for a, b in zip(offs[:-1], offs[1:])], np.int32)


def _windows(buf: np.ndarray, offs: np.ndarray):
    """Of every window: text, word position, edge hash, smallest gram hash."""
    w = W.split_words(buf, offs, W.SPACE_WORDS)
    h = w.hashes()
    at, doc = w.windows(K)
    least = W.window_hashes(h, GRAM)
    span, width = K - GRAM + 1, 1
    while 2 * width <= span:                      # sliding minimum by doubling
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    return w, doc, (at - w.first[doc]).astype(np.int32), W.window_hashes(h, K)[at], least[at] if len(at) else at.astype(W.U64)


def _paths(doc, tag, begin, source_doc, source_begin):
    """Consecutive windows with consecutive sources as one row each."""
    if not len(doc):
        return [np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int64, np.int32)]
    order = np.lexsort((begin, tag, doc))
    doc, tag, begin, source_doc, source_begin = (x[order] for x in (doc, tag, begin, source_doc, source_begin))
    new = np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (begin[1:] != begin[:-1] + 1)
                | (source_doc[1:] != source_doc[:-1]) | (source_begin[1:] != source_begin[:-1] + 1)]
    at = np.flatnonzero(new)
    return [doc[at], tag[at], begin[at], np.diff(np.r_[at, len(doc)]).astype(np.int32), source_doc[at],
            source_begin[at]]


def _repeats(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of coordinates: their order by edge, and of each in
    that order the place of its edge's first."""
    order = np.argsort(h, kind="stable")
    if not len(order):
        return order, order
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def _new_in_chunk(batch: pa.RecordBatch):
    """Of each chunk in order of coordinates: the paths of the windows that
    repeat within it, and the windows whose edge is new in it."""
    ids = batch.column(0).fill_null(LAST).to_numpy()
    for row, buf, offs in W.chunks(batch.column(1), 4 << 20):
        _, d, begin, h, least = _windows(buf, offs)
        doc, tag = ids[row + d], _tags(buf, offs)[d]
        g = (least >> W.U64(32)).astype(np.uint32)
        if (doc[1:] < doc[:-1]).any():
            by = np.lexsort((begin, doc))
            doc, tag, begin, h, g, least = (x[by] for x in (doc, tag, begin, h, g, least))
        order, first = _repeats(h, g)
        src = order[first]
        # an equal coordinate (a repeated row) is not an earlier start
        earlier = (doc[order] != doc[src]) | (begin[order] != begin[src])
        again = order[earlier]
        paths = _paths(doc[again], tag[again], begin[again], doc[src[earlier]], begin[src[earlier]])
        keep = np.sort(order[~earlier])
        yield offs, paths, *(x[keep] for x in (doc, tag, begin, h, g, least))


def _counts(parts: int):
    """How many windows each part would get: of each task all its windows, as
    part -1, and the parts with more than 1.5 times the task's mean.  What is
    not told adds up to 1.5 means of a part at most."""
    def run(batches):
        total = np.zeros(parts, np.int64)
        for batch in batches:
            for *_, least in _new_in_chunk(batch):
                total += np.bincount((least % W.U64(parts)).astype(np.int64), minlength=parts)
        some = np.flatnonzero(2 * parts * total > 3 * total.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)),
                                          pa.array(np.r_[total.sum(), total[some]])], ["part", "n"])
    return run


def _split(counts: dict[int, int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every part, the first of the parts it is dealt on to and how many there are."""
    first, ways = np.arange(parts), np.ones(parts, np.int64)
    mean = max(1, -(-counts.get(-1, 0) // parts))
    for part, n in sorted(counts.items()):
        if part >= 0 and n > 2 * mean:
            ways[part] = -(-n // mean)
    hot = np.flatnonzero(ways > 1)
    first[hot] = parts + np.cumsum(ways[hot]) - ways[hot]
    return first, ways


def _edges(first_of: np.ndarray, ways: np.ndarray):
    """Rows for the exchange: per chunk and part the runs of windows whose edge
    is new in the chunk, and the paths of those that repeat within it."""
    parts = len(ways)

    def run(batch: pa.RecordBatch):
        for offs, paths, doc, tag, begin, h, g, least in _new_in_chunk(batch):
            part = (least % W.U64(parts)).astype(np.int64)
            part = (first_of[part] + ((h >> W.U64(32)) % ways[part].astype(W.U64)).astype(np.int64)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, doc, tag, begin, h, g = (x[order] for x in (part, doc, tag, begin, h, g))
            if len(part):
                new = np.r_[True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
                            | (begin[1:] != begin[:-1] + 1) | (g[1:] != g[:-1])]
                at = np.flatnonzero(new)
                of_part, first_w = np.unique(part, return_index=True)
                of_run = np.searchsorted(at, first_w)
                runs, wins = np.append(of_run, len(at)), np.append(first_w, len(part))
                yield {"part": pa.array(of_part), "doc_id": W.lists(doc[at], runs, pa.int64()),
                       "tag": W.lists(tag[at], runs, pa.int32()), "begin": W.lists(begin[at], runs, pa.int32()),
                       "n": W.lists(np.diff(np.r_[at, len(part)]).astype(np.int32), runs, pa.int32()),
                       "gram": W.lists(g[at].view(np.int32), runs, pa.int32()),
                       "edge": W.lists(W.signed(h), wins, pa.int64()),
                       "source_doc": pa.nulls(len(of_part), pa.list_(pa.int64())),
                       "source_begin": pa.nulls(len(of_part), pa.list_(pa.int32()))}
            if len(paths[0]):
                one = np.array([0, len(paths[0])])
                spread = int.from_bytes(hashlib.blake2b(offs.tobytes(), digest_size=4).digest(), "little") % parts
                yield {"part": pa.array([spread], pa.int32()), "doc_id": W.lists(paths[0], one, pa.int64()),
                       "tag": W.lists(paths[1], one, pa.int32()), "begin": W.lists(paths[2], one, pa.int32()),
                       "n": W.lists(paths[3], one, pa.int32()), "gram": pa.nulls(1, pa.list_(pa.int32())),
                       "edge": pa.nulls(1, pa.list_(pa.int64())), "source_doc": W.lists(paths[4], one, pa.int64()),
                       "source_begin": W.lists(paths[5], one, pa.int32())}
    return run


_EXCHANGE = ("part int, doc_id array<long>, tag array<int>, begin array<int>, n array<int>, gram array<int>, "
             "edge array<long>, source_doc array<long>, source_begin array<int>")


def _out(paths) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(p) for p in paths],
                                      ["doc_id", "tag", "begin", "n", "source_doc", "source_begin"])


def _sources(batches):
    """All rows of some parts: the edges' first coordinates, as paths."""
    held = []
    for batch in batches:
        get = lambda name, rows: batch.column(batch.schema.get_field_index(name)).filter(rows).flatten().to_numpy()  # noqa: E731,B023
        travelled = batch.column(batch.schema.get_field_index("edge")).is_valid()
        settled = pc.invert(travelled)
        if pc.any(settled).as_py():
            yield _out([get(c, settled) for c in ("doc_id", "tag", "begin", "n", "source_doc", "source_begin")])
        held.append([get(c, travelled) for c in ("doc_id", "tag", "begin", "n", "gram", "edge")])
    if not held:
        return
    doc, tag, begin, n, gram, edge = (np.concatenate(x) for x in zip(*held))
    del held
    if not len(edge):
        return
    by = np.lexsort((begin, doc))
    ends = np.cumsum(n)
    doc, tag, gram, begin, n, at = doc[by], tag[by], gram[by], begin[by], n[by], (ends - n)[by]
    inner = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
    edge = edge[np.repeat(at, n) + inner]
    doc, tag, gram = np.repeat(doc, n), np.repeat(tag, n), np.repeat(gram, n)
    begin = np.repeat(begin, n) + inner.astype(np.int32)
    order, first = _repeats(edge, gram)
    src = order[first]
    earlier = (doc[order] != doc[src]) | (begin[order] != begin[src])
    again, src = order[earlier], src[earlier]
    yield _out(_paths(doc[again], tag[again], begin[again], doc[src], begin[src]))


def repeated_paths(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, begin, n, source_doc, source_begin``: nonbranching paths
    of ``n`` repeated windows from word ``begin`` on, and an earlier place of
    the same ``n + K - 1`` words.  A window is in a path if and only if its
    words start earlier as well.  A null doc_id reads as the largest long."""
    parts = n_partitions(docs.sparkSession)
    texts = text_of(docs)
    counts = texts.mapInArrow(_counts(4 * parts), "part int, n long").groupBy("part").agg(F.sum("n").alias("n"))
    rows = map_batches(texts, _edges(*_split(dict(map(tuple, counts.collect())), 4 * parts)), _EXCHANGE)
    found = rows.repartition(parts, "part").mapInArrow(_sources, _PATHS)
    along = Window.partitionBy("doc_id", "tag").orderBy("begin", "source_doc", "source_begin")
    joins_on = ((F.lag("source_doc").over(along) == F.col("source_doc"))
                & (F.lag(F.col("begin") + F.col("n")).over(along) == F.col("begin"))
                & (F.lag(F.col("source_begin") + F.col("n")).over(along) == F.col("source_begin")))
    chained = found.withColumn("new", F.when(joins_on, 0).otherwise(1)).withColumn("path", F.sum("new").over(along))
    return (chained.groupBy("doc_id", "tag", "path")
            .agg(F.min("begin").alias("begin"), F.sum("n").cast("int").alias("n"),
                 F.first("source_doc").alias("source_doc"), F.min("source_begin").alias("source_begin")).drop("path"))


def _scan(batch: pa.RecordBatch):
    pack = zstandard.ZstdCompressor(level=1)
    for row, buf, offs in W.chunks(batch.column(1)):
        n = len(offs) - 1
        packed = [pack.compress(buf[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:])]
        yield {"key": batch.column(0).slice(row, n).fill_null(LAST), "doc_id": batch.column(0).slice(row, n),
               "tag": pa.array(_tags(buf, offs)), "packed": pa.array(packed, pa.binary())}


def _remove(batch: pa.RecordBatch):
    spans = batch.column(batch.schema.get_field_index("spans"))
    begins, lengths = spans.values.field("begin").to_numpy(), spans.values.field("n").to_numpy()
    where = spans.offsets.to_numpy()
    unpack = zstandard.ZstdDecompressor()
    texts = pa.array([unpack.decompress(x.as_py()) for x in batch.column(batch.schema.get_field_index("packed"))],
                     pa.large_binary()).cast(pa.large_string())
    for row, buf, offs in W.chunks(texts):
        w = W.split_words(buf, offs, W.SPACE_WORDS)
        n_removed, kept, left_over = [], [], []
        for d in range(len(offs) - 1):
            a, b = w.first[d], w.first[d + 1]
            mark = np.zeros(b - a + 1, np.int64)
            lo, hi = where[row + d], where[row + d + 1]
            if hi > lo:
                np.add.at(mark, begins[lo:hi], 1)
                np.add.at(mark, begins[lo:hi] + lengths[lo:hi] + (K - 1), -1)
            gone = np.cumsum(mark[:-1]) > 0
            raw = buf.tobytes() if d == 0 else raw
            left = b" ".join([raw[s:e] for s, e in zip(w.start[a:b][~gone].tolist(), w.end[a:b][~gone].tolist())])
            n_removed.append(int(gone.sum()))
            kept.append(hashlib.sha256(left).hexdigest())
            left_over.append(left)
        yield {"doc_id": batch.column(batch.schema.get_field_index("doc_id")).slice(row, len(offs) - 1),
               "n_words": pa.array(w.counts(), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
               "kept_sha256": pa.array(kept), "kept_text": pa.array(left_over, pa.binary()).cast(pa.string())}


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, if wanted, ``kept_text``
    (the kept words joined by one space) of every row of ``docs(doc_id, text)``."""
    paths = (repeated_paths(docs).groupBy(F.col("doc_id").alias("key"), "tag")
             .agg(F.collect_list(F.struct("begin", "n")).alias("spans")))
    rows = map_batches(text_of(docs), _scan, "key long, doc_id long, tag int, packed binary")
    joined = rows.join(paths, ["key", "tag"], "left").select("doc_id", "packed", "spans")
    out = map_batches(joined, _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")
