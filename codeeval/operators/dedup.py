"""Deduplication: against a hash ledger, within a batch, against a main
dataset; and appending passing snippets to the main dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from .ordinals import global_ordinal, keep_first


def with_snippet_hash(pairs: DataFrame, prompt: str = "prompt", code: str = "code",
                      out: str = "snippet_hash") -> DataFrame:
    """X7 as a column: sha256(prompt + code) of the *uncleaned* code."""
    return pairs.withColumn(out, T.snippet_hash(prompt, code))


def dedup_ledger(pairs: DataFrame, ledger: DataFrame | None,
                 order: tuple[str, ...] = ("conv_id", "k")) -> DataFrame:
    """Pairs to process in this run.

    A pair is skipped when its hash is in the ledger or an earlier pair of
    this run (by ``order``) had the same hash.  ``pairs`` must carry
    ``snippet_hash``.  Keep-first aggregates hashes and order columns only;
    the ledger check is an anti-join on the hash.  A pair without a hash (a
    null prompt or code) cannot be recognised and is always processed.
    """
    first = keep_first(pairs.filter(F.col("snippet_hash").isNotNull()), ["snippet_hash"], list(order))
    if ledger is not None:
        first = first.join(ledger.select("snippet_hash"), "snippet_hash", "left_anti").select(*pairs.columns)
    return first.unionByName(pairs.filter(F.col("snippet_hash").isNull()))


def ledger_update(ledger: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """New ledger = old ledger plus every hash seen in this run (passed or
    failed).  Written append-only by the caller."""
    seen = pairs.select("snippet_hash")
    return seen.distinct() if ledger is None else ledger.select("snippet_hash").union(seen).distinct()


#: Slots of the bit table that spares main values the shuffle: 1 MB, whatever the size of the data.
SLOTS = 1 << 23


def _possible(rows: DataFrame, h: str, hashes: DataFrame) -> DataFrame:
    """The rows whose hash column ``h`` may be in the one column of ``hashes``.  The
    executors set one bit per hash in a table of ``SLOTS`` bits, kept as rows of 4 KB that
    Spark broadcasts for their size, so a row that no hash can match ends where it is read."""
    slot = lambda c: F.pmod(F.col(c), F.lit(SLOTS)) + 1
    table = (hashes.select(slot(hashes.columns[0]).alias("_s")).groupBy(F.bitmap_bucket_number("_s").alias("_bucket"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits"))
             .limit(SLOTS // 32768))        # cuts nothing, there are no more buckets; it tells Spark the table's size
    at = F.bitmap_bit_position(slot(h))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, _at)").bitwiseAND(1) == 1
    return (rows.withColumn("_bucket", F.bitmap_bucket_number(slot(h))).join(table, "_bucket")
            .withColumn("_byte", byte).withColumn("_at", (at % 8).cast("int")).where(bit).select(*rows.columns))


def duplicate_keys(pairs: DataFrame, main_messages: DataFrame, key: list[str],
                   prompt: str = "prompt", code: str = "code") -> DataFrame:
    """Keys of the pairs whose prompt or code equals a message of ``main_messages``.

    Main values that no pair's hash can match are dropped where they are read, by a bit
    table of the pairs' 64-bit hashes; then hashes find the candidates (only keys and
    hashes move), and texts are compared exactly, candidates against the main values
    that share a hash with some pair.  One plan at any size: with more pairs the bit
    table lets more pass, and the joins after it decide."""
    sides = F.inline(F.array(F.struct(F.xxhash64(prompt).alias("_h"), F.col(prompt).alias("_v")),
                             F.struct(F.xxhash64(code).alias("_h"), F.col(code).alias("_v"))))
    hashed = pairs.select(*key, sides)
    values = main_messages.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("_h"), F.col("text").alias("_v"))
    values = _possible(values, "_h", hashed.select("_h"))
    candidates = hashed.select(*key, "_h").join(values.select("_h"), "_h", "left_semi")
    texts = pairs.join(candidates.select(*key), key, "left_semi").select(*key, sides)
    shared = values.join(candidates.select("_h"), "_h", "left_semi")
    return texts.join(shared, ["_h", "_v"], "left_semi").select(*key).distinct()


def dedup_against_main(pairs: DataFrame, main_messages: DataFrame, prompt: str = "prompt", code: str = "code",
                       key: tuple[str, ...] = ("conv_id", "k"), prefixed: bool = False) -> DataFrame:
    """Drop pairs whose prompt or code equals any message value (any
    role) of the main dataset.  Exact equality; a null never matches.  ``key``
    identifies a pair.  One plan at any size.

    ``prefixed`` compares prompts as the verdict path writes them, with the
    ``Human: `` prefix, so a raw main prompt never matches (Q1)."""
    seen = pairs.withColumn(prompt, F.concat(F.lit(fixed.HUMAN_PREFIX), F.col(prompt))) if prefixed else pairs
    return pairs.join(duplicate_keys(seen, main_messages, list(key), prompt, code), list(key), "left_anti")


def append_working(main_messages: DataFrame, passing_pairs: DataFrame,
                   order: tuple[str, ...] = ("conv_id", "k"), prefixed: bool = False) -> DataFrame:
    """Passing, non-duplicate pairs become 2-message conversations
    appended after the main dataset, in ``order``, which identifies a pair (a
    repeated key is an error).  Duplicates inside the batch are kept.  An
    empty main dataset gets nothing appended.  ``prefixed``: prompts are
    compared and stored with their ``Human: `` prefix (Q1).

    Returns the whole new main dataset as messages."""
    key = list(order)
    if prefixed:
        passing_pairs = passing_pairs.withColumn("prompt", F.concat(F.lit(fixed.HUMAN_PREFIX), F.col("prompt")))
    dup = duplicate_keys(passing_pairs, main_messages, key)
    # the duplicate check runs once: the ordinals hold exactly the keys that stay
    ords = global_ordinal(passing_pairs.select(*key).join(dup, key, "left_anti"), key, out="_ord", unique=True)
    base = main_messages.agg(F.max("conv_id").alias("_max"))      # one row
    appended = (passing_pairs.join(ords, key)
                   .crossJoin(F.broadcast(base))                   # one-row side
                   .filter(F.col("_max").isNotNull())
                   .select((F.col("_max") + 1 + F.col("_ord")).alias("conv_id"),
                           F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit(fixed.HUMAN).alias("role"),
                                            F.col("prompt").alias("text")),
                                   F.struct(F.lit(1).cast("long").alias("turn"), F.lit(fixed.ASSISTANT).alias("role"),
                                            F.col("code").alias("text"))).alias("_m"))
                   .select("conv_id", F.inline("_m")))
    return main_messages.select("conv_id", "turn", "role", "text").unionByName(appended)
