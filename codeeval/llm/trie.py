"""Operator 13: the prefix trie of conversations by van Emde Boas recursion.

Every sequence of first d turns (role, text) of a conversation is a node of depth
d; the empty one is the root.  The trie is never walked turn by turn.  It is cut at
half its height, the upper part and the forest of lower parts are cut at half theirs,
and so on, all parts of one height at once:

1. a turn is named by a digest of its role and text, and a block of 2^k turns by the
   digest of its halves' names, from k = 0 up;
2. from the whole height down, each part of height 2^(k+1) is cut in the middle: the
   cut prefix ``mid`` is named by the name of the part's ``top`` and that of the
   block between, and ``low``, a prefix on the part's lower rim, hangs on mid.  So
   after log2(height) rounds every prefix has its name, and every cut has left two
   sets of links, mid to top and low to mid;
3. totals are grafted upward along the links: from the smallest parts up, the total of
   each cut's lower part goes to its top, which then has its whole part; then, from
   the whole height down, what hangs on each cut's rim goes to the middle, which has
   all that is below it then.

A level of the recursion moves narrow rows, one per 2^k turns, never texts.
Names are 128 bits, and equal names count as equal prefixes.  Nothing gathers
a conversation, the members of a node or its children in one row: counts are partial
aggregates, and the digest of members reads them in order, a block of ``ID_BLOCK``
ids at a time.

Turns are ordered by ``turn`` (null first); those with the same number by their
digest.  Null roles and texts are empty.  Repeated rows are turns of their own.
Rows without conv_id take no part.  Other columns are ignored.  Without conversations
there is no node, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import rank_in_order
from .tables import n_partitions, saved, spread_join

ID_BLOCK = 4096
NAME = ["p", "q"]
#: ``rebuilt`` copies up to this many turns (crc32 % 6).
MOST_COPIED = 5
BASES = 100


def _named(*parts: Column | str, prefix: str = "") -> list[Column]:
    """Two 64-bit digests of the same columns."""
    return [F.xxhash64(F.lit(k), *parts).alias(prefix + n) for k, n in enumerate(NAME)]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, p, q, chars``: turns by their place in the conversation, from 1, with their names."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *_named(role, text), F.length(text).cast("long").alias("chars"))
    ranked = rank_in_order(rows, ["conv_id"], ["turn", *NAME], out="rank")
    return ranked.select("conv_id", (F.col("rank") + 1).alias("pos"), *NAME, "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as by ``turns_of``, and all conv_ids, of the conversations rebuilt:
    the first h turns of conversation c - c % 100, then the own turns of c after its
    first h, with h = crc32(c) % 6."""
    own = saved(turns_of(conversations), "turns")
    ids = saved(own.select("conv_id").distinct(), "ids")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_COPIED + 1)
    base = F.col("conv_id") - F.col("conv_id") % BASES
    first = saved(own.where((F.col("pos") <= MOST_COPIED) & (F.col("conv_id") == base)), "first")
    copied = (ids.select("conv_id", h.alias("h"), base.alias("base"))
              .join(first.withColumnRenamed("conv_id", "base"), "base").where("pos <= h"))
    size = first.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("size"))
    rest = spread_join(own.withColumns({"h": h, "base": base}).where("pos > h"), size, ["base"], F.struct("conv_id", "pos"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0))))
    columns = ["conv_id", "pos", *NAME, "chars"]
    return saved(copied.select(*columns).union(rest.select(*columns)), "rebuilt"), ids


def _blocks(turns: DataFrame, height: int) -> list[DataFrame]:
    """For k from 0: ``conv_id, j, p, q``, the names of the j-th 2^k turns of each conversation."""
    levels = [turns.select("conv_id", (F.col("pos") - 1).alias("j"), *NAME)]
    for _ in range(height - 1):
        half = lambda n, r: F.max(F.when(F.col("j") % 2 == r, F.col(n))).alias(f"{n}{r}")
        pairs = (levels[-1].groupBy("conv_id", F.shiftright("j", 1).alias("j"))
                 .agg(F.count("*").alias("n"), *(half(n, r) for r in (0, 1) for n in NAME)).where("n = 2"))
        levels.append(saved(pairs.select("conv_id", "j", *_named("p0", "q0", "p1", "q1")), "blocks"))
    return levels


def _cuts(turns: DataFrame, members: DataFrame, height: int) -> tuple[DataFrame, list[DataFrame]]:
    """``conv_id, depth, p, q`` of every prefix of every conversation, and for each
    k the cuts of parts of height 2^(k+1): ``top``, ``mid`` and ``low`` (null where
    the conversation does not reach the rim)."""
    blocks, cuts = _blocks(turns, height), []
    prefixes = members.select("conv_id", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(n) for n in NAME))
    for k in range(height - 1, -1, -1):
        step = 1 << (k + 1)
        at = lambda s: [F.col(n).alias(f"{s}_{n}") for n in NAME]
        top = prefixes.select("conv_id", "depth", *at("top"))
        low = prefixes.select("conv_id", (F.col("depth") - step).alias("depth"), *at("low")).where("depth >= 0")
        upper = blocks[k].where("j % 2 = 0").select("conv_id", F.shiftleft("j", k).alias("depth"), *at("block"))
        names = _named(*(f"{s}_{n}" for s in ("top", "block") for n in NAME), prefix="mid_")
        cut = saved(top.join(upper, ["conv_id", "depth"]).join(low, ["conv_id", "depth"], "left")
                    .select("conv_id", F.col("depth").alias("top_depth"), *(f"top_{n}" for n in NAME), *names,
                            *(f"low_{n}" for n in NAME)), "cuts")
        cuts.insert(0, cut)
        prefixes = prefixes.union(cut.select("conv_id", F.col("top_depth") + (1 << k), *(f"mid_{n}" for n in NAME)))
    return prefixes, cuts


def _links(cut: DataFrame, child: str, parent: str, *more: str) -> DataFrame:
    """One row for each child of a cut: its name as ``p, q`` and its parent's as ``to_p, to_q``."""
    return (cut.where(f"{child}_p IS NOT NULL")
            .select(*(F.col(f"{child}_{n}").alias(n) for n in NAME), *(F.col(f"{parent}_{n}").alias(f"to_{n}") for n in NAME), *more)
            .distinct())


def _level(depth: str) -> Column:
    """How often a depth can be halved."""
    return F.log2(F.col(depth).bitwiseAND(-F.col(depth)).cast("double")).cast("int")


def _sums(rows: list[DataFrame], keys: list[str] = NAME) -> DataFrame:
    """``leaves`` and ``tokens`` added up by name."""
    every = reduce(DataFrame.union, [r.select(*keys, "leaves", "tokens") for r in rows])
    return every.groupBy(*keys).agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))


def _totals(nodes: DataFrame, cuts: list[DataFrame]) -> DataFrame:
    """``p, q, leaves, tokens``: of each node, the sums over its subtree."""
    height, own, grafts = len(cuts), [], []
    to = [F.col(f"to_{n}").alias(n) for n in NAME]
    for k in range(height):
        own.append(saved(_sums([nodes.where(F.col("level") == k), *(g.where(F.col("level") == k) for g in grafts)]), "part"))
        up = _links(cuts[k], "mid", "top", "top_depth").join(own[k], NAME)
        grafts.append(saved(_sums([up.select(F.when(F.col("top_depth") == 0, height).otherwise(_level("top_depth")).alias("level"),
                                             *to, "leaves", "tokens")], ["level", *NAME]), "grafts"))
    whole = saved(_sums([nodes.where("depth = 0"), *(g.where(F.col("level") == height) for g in grafts)]), "totals")
    for k in range(height - 1, -1, -1):
        hangs = _links(cuts[k], "low", "mid").join(whole, NAME).select(*to, "leaves", "tokens")
        whole = whole.union(saved(_sums([own[k], hangs]), "totals"))
    return whole


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each name's blocks of ids, which follow each other in order."""
    name, digest = None, None

    def told(p, q, d):
        return pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64()), pa.array(d, pa.string())],
                                          [*NAME, "ends_sha256"])

    for batch in batches:
        ps, qs, ds = [], [], []
        for p, q, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if name == (p, q):
                digest.update(b"," + ids.encode())
                continue
            if name:
                ps.append(name[0]), qs.append(name[1]), ds.append(digest.hexdigest())
            name, digest = (p, q), hashlib.sha256(ids.encode())
        yield told(ps, qs, ds)
    if name:
        yield told([name[0]], [name[1]], [digest.hexdigest()])


def _ends(ends: DataFrame) -> DataFrame:
    """``p, q, ends_sha256`` of the conversations ``(p, q, conv_id)``, ids ascending and comma-joined."""
    blocks = (ends.groupBy(*NAME, F.floor(F.col("conv_id") / ID_BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
              .select(*NAME, "block", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids")))
    return (blocks.repartition(n_partitions(ends.sparkSession), *NAME).sortWithinPartitions(*NAME, "block")
            .select(*NAME, "ids").mapInArrow(_digests, "p long, q long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the conversations ``members(conv_id)`` with ``turns(conv_id, pos, p, q, chars)`` as by
    ``turns_of``: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree: members but one, times ``chars`` of the last turn) and ``ends_sha256``."""
    sizes = saved(members.join(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left")
                  .select("conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n")), "sizes")
    height = int(sizes.agg(F.max("n")).first()[0] or 0).bit_length()
    prefixes, cuts = _cuts(turns, members, height)

    counted = prefixes.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
                                          F.count("*").alias("n_convs"))
    parents = [_links(cuts[0], *pair) for pair in (("mid", "top"), ("low", "mid"))] if cuts else []
    if parents:
        parent = saved(parents[0].union(parents[1]), "parents")
        children = parent.groupBy(*(F.col(f"to_{n}").alias(n) for n in NAME)).agg(F.count("*").alias("n_children"))
        counted = counted.join(parent, NAME, "left").join(children, NAME, "left")
    else:
        counted = counted.selectExpr("*", "NULL AS to_p", "NULL AS to_q", "NULL AS n_children")
    chars = turns.select("conv_id", F.col("pos").alias("depth"), "chars")
    nodes = saved(counted.join(chars, ["conv_id", "depth"], "left").select(
        *NAME, F.col("to_p").cast("long").alias("to_p"), F.col("to_q").cast("long").alias("to_q"), "conv_id", "depth", "n_convs",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children") > 0, 0).otherwise(1).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0))).alias("tokens"),
        F.when(F.col("depth") > 0, _level("depth")).alias("level")), "nodes")

    totals = _totals(nodes, cuts).withColumnsRenamed({"leaves": "n_leaves", "tokens": "saved_tokens"})
    ends = _ends(sizes.select("conv_id", F.col("n").alias("depth")).join(prefixes, ["conv_id", "depth"])
                 .select(*NAME, "conv_id"))
    above = nodes.select(F.col("p").alias("to_p"), F.col("q").alias("to_q"), F.col("conv_id").alias("parent_conv_id"))
    return (spread_join(nodes, above, ["to_p", "to_q"], F.struct(*NAME))
            .join(totals, NAME).join(ends, NAME, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
