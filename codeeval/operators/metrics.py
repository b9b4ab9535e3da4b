"""Sentence BLEU (M1), sentence chrF (M2) and their averages (M3).

Plan shape (both metrics)
-------------------------
1. Rows are dealt by their ids, so that texts spread over all tasks however few files
   they lie in and rows with equal ids meet.  A text becomes an array of units: hashes
   of its word tokens (``text.word_tokens``), or its code points.
2. A pair of up to ``LOCAL_UNITS`` units is counted in its row, by arrays of numbers:
   the n-grams on both sides, and from the runs of the sorted repeats how often they
   match again.  Of it only a row per order is shuffled.
3. A longer pair, and rows that share their ids (they are scored as one), expand into
   n-grams with two ``explode`` generators (positions, then orders), streamed in
   codegen.  One aggregate counts each n-gram of a pair on both sides at once, keyed by
   (pair id, order, n-gram).  It is partial before the exchange, and since the
   n-gram is part of the key a single long text spreads over all partitions;
   there is no join, so no side must fit a task.
4. A second, narrow aggregate per pair sums the clipped counts by order.  Rows
   of order 0 carry the lengths, also of empty texts.
5. The closing formula is a column expression over the per-pair counts.

Word n-grams are keyed by a 64-bit hash (within one pair and order; repeats counted in
the row by 63 bits of it), character n-grams exactly: by two longs of three 21-bit code
points, or in the row by one long of six 10-bit codes.

Formulas (public definitions)
-----------------------------
BLEU-4, uniform weights, one reference, smoothing "method 4": clipped
n-gram precision with denominator max(1, #hyp n-grams); 0 if no unigram
matches; zero numerators are replaced, in order j = 1, 2, ..., by
1 / (2^j * 5 / ln(hyp_len)) when hyp_len > 1; precisions that stay 0 are
left out of the geometric mean; brevity penalty 1 if hyp > ref, 0 if the
hypothesis is empty, else exp(1 - ref/hyp).

chrF: whitespace removed, character 1..6-grams, beta = 2; precision and
recall are averaged over the orders where both sides have n-grams and
combined as F_beta; 0 when both averages are 0.  Scaled to 0..1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T

#: Up to so many units that both sides share are looked up to skip n-grams.
COMMON_UNITS = 256
#: Pairs of up to so many units, both sides together, are counted in their row.
LOCAL_UNITS = 1 << 17
#: Bits of a character's code in an n-gram that is counted in the row.
CODE_BITS = 10


def _positions(u: Column) -> Column:
    """0 .. size - 1."""
    return F.when(F.size(u) > 0, F.sequence(F.lit(0), F.size(u) - 1)).otherwise(F.array().cast("array<int>"))


def _repeats(k: Column) -> Column:
    """Of a sorted array every value but the first of each run."""
    return F.filter(k, lambda x, i: x == F.get(k, i - 1))


def _marked(r: Column, h: Column) -> Column:
    """Both sides' n-grams sorted together, the reference's as even and the hypothesis's as
    the next odd number."""
    return F.sort_array(F.concat(F.transform(r, lambda x: F.shiftleft(x, 1)),
                                 F.transform(h, lambda x: F.shiftleft(x, 1).bitwiseOR(F.lit(1).cast("long")))))


def _clipped(s: Column) -> Column:
    """Sum over the n-grams of ``_marked`` of the lesser count of the two sides."""
    starts = F.filter(_positions(s), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))

    def matched(p: Column) -> Column:
        def add(acc: Column, j: Column) -> Column:
            same = F.get(s, F.get(p, j)) == F.get(s, F.get(p, j - 1)).bitwiseOR(F.lit(1).cast("long"))
            n_ref, n_hyp = F.get(p, j) - F.get(p, j - 1), F.coalesce(F.get(p, j + 1), F.size(s)) - F.get(p, j)
            return acc + F.when(same, F.least(n_ref, n_hyp)).otherwise(0)
        return F.when(F.size(p) > 1, F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0), add)).otherwise(0)

    return F.get(F.transform(F.array(starts), matched), F.lit(0))


def _local_matches(d: DataFrame, max_n: int) -> DataFrame:
    """``m1``.. of the rows to be counted in place, from the n-grams ``r1``.., ``h1``..: the
    distinct n-grams of both sides, and the clipped matches among the repeated ones, which
    are few."""
    orders = range(1, max_n + 1)
    local = F.col("local")
    keep = ["r", "h"]
    d = d.select("*", *(F.when(local, F.sort_array(f"{u}{n}")).alias(f"{u}s{n}") for u in keep for n in orders)) \
         .drop(*(f"{u}{n}" for u in keep for n in orders))
    d = d.select("*", *(F.size(F.array_intersect(f"rs{n}", f"hs{n}")).alias(f"both{n}") for n in orders),
                 *(F.when(local, _repeats(F.col(f"{u}s{n}"))).alias(f"{u}r{n}") for u in keep for n in orders)) \
         .drop(*(f"{u}s{n}" for u in keep for n in orders))
    d = d.select("*", *(F.when(local, _marked(F.col(f"rr{n}"), F.col(f"hr{n}"))).alias(f"s{n}") for n in orders))
    return d.select("*", *(F.when(local, F.col(f"both{n}") + _clipped(F.col(f"s{n}"))).alias(f"m{n}") for n in orders))


def _ngram_stats(pairs: DataFrame, ids: list[str], reference: str, candidate: str, units, max_n: int, gram,
                 local, skip: bool = False) -> DataFrame:
    """Per pair: hyp_len, ref_len and clipped matches m1..m{max_n}.

    ``units`` gives a text's units to n-gram (hashes of tokens, or code points) and
    ``gram(u, i, n)`` the key columns of the n-gram at 1-based ``i``.  ``local`` adds to
    the rows with units ``r`` and ``h`` the columns ``local`` (counted in the row?) and,
    for those, the n-grams of each order as numbers, ``r1``.. and ``h1``...
    ``skip`` leaves out n-grams that begin with a unit the other side lacks,
    which cannot match; in a row with over ``COMMON_UNITS`` units in common
    looking that up would cost more than it saves, and nothing is left out.
    """
    alone = F.count(F.lit(1)).over(Window.partitionBy(*ids)) == 1
    d = (pairs.select(*ids, F.col(reference).alias("r"), F.col(candidate).alias("h")).withColumn("alone", alone)
              .select(*ids, units("r").alias("r"), units("h").alias("h"), "alone")
              .withColumn("alone", F.col("alone") & (F.size("r") + F.size("h") <= LOCAL_UNITS))
              .withColumn("common", F.array_intersect("r", "h") if skip else F.lit(None)))
    d = _local_matches(local(d), max_n)
    none = F.array().cast(d.schema["r"].dataType)
    totals = F.array(F.size("h"), F.size("r"), *(F.col(f"m{n}") for n in range(1, max_n + 1)))

    def side(number: int, u: Column, counted: Column) -> Column:
        # with the ids, as columns anew: the n-grams are to be dealt by more than the ids
        return F.struct(*ids, F.lit(number).alias("side"), u.alias("u"), counted.cast("array<int>").alias("counted"))

    sides = d.select("common", F.inline(
        F.when(F.col("local"), F.array(side(0, none, totals)))
         .otherwise(F.array(side(0, F.col("r"), F.lit(None)), side(1, F.col("h"), F.lit(None))))))
    u, i, n, counted = F.col("u"), F.col("i"), F.col("n"), F.col("counted")
    can = (F.size(u) > 0) & ((F.size("common") > COMMON_UNITS) | F.array_contains("common", F.get(u, i - 1))) \
        if skip else F.size(u) > 0
    keys = [F.when(counted.isNull(), c).alias(f"g{j}") for j, c in enumerate(gram(u, i, n))]
    # an order-0 row carries a side's length; a counted pair has one row per order, no n-grams
    grams = (sides.select(*ids, "side", "u", "common", "counted",
                          F.explode(F.sequence(F.lit(1), F.greatest(F.size(u), F.lit(1)))).alias("i"))
                  .withColumn("can", can).filter((i == 1) | F.col("can"))
                  .select(*ids, "side", "u", "i", "can", "counted", F.explode(F.array(*map(F.lit, range(max_n + 1)))).alias("n"))
                  .filter(counted.isNotNull() | F.when(n == 0, i == 1).otherwise(F.col("can") & (i + n - 1 <= F.size(u))))
                  .select(*ids, "side", "n", "counted", F.when(n == 0, F.size(u)).otherwise(1).alias("w"), *keys)
                  .select(*ids, "n", *[f"g{j}" for j in range(len(keys))],
                          F.when(counted.isNull(), F.col("w") * F.col("side"))
                           .otherwise(F.get(counted, F.when(n == 0, 0).otherwise(n + 1))).alias("ch"),
                          F.when(counted.isNull(), F.col("w") * (1 - F.col("side"))).otherwise(F.get(counted, n + 1)).alias("cr")))
    counts = (grams.groupBy(*ids, "n", *[f"g{j}" for j in range(len(keys))])
                   .agg(F.sum("ch").alias("ch"), F.sum("cr").alias("cr")))

    def total(order: int, value: Column) -> Column:
        return F.sum(F.when(n == order, value).otherwise(0))

    return counts.groupBy(*ids).agg(
        total(0, F.col("ch")).alias("hyp_len"), total(0, F.col("cr")).alias("ref_len"),
        *[total(k, F.least("ch", "cr")).alias(f"m{k}") for k in range(1, max_n + 1)])


def _token_hashes(text: str) -> Column:
    return F.transform(T.word_tokens(text), lambda t: F.xxhash64(t))


def _token_gram(u: Column, i: Column, n: Column) -> list[Column]:
    """A word n-gram as a 64-bit hash of its tokens' hashes."""
    return [F.xxhash64(F.slice(u, i, n))]


def _local_tokens(d: DataFrame) -> DataFrame:
    def starts(u: str) -> Column:
        every = _positions(F.col(u))
        return F.when(F.size("common") > COMMON_UNITS, every) \
                .otherwise(F.filter(every, lambda i: F.array_contains("common", F.get(u, i))))

    def grams(u: str, n: int) -> Column:
        return F.transform(F.filter(f"{u}_at", lambda i: i + n <= F.size(u)),
                           lambda i: F.xxhash64(*(F.get(u, i + j) for j in range(n))))

    d = d.withColumn("local", F.col("alone"))
    d = d.select("*", *(F.when(F.col("local"), starts(u)).alias(f"{u}_at") for u in ("r", "h")))
    return d.select("*", *(F.when(F.col("local"), grams(u, n)).alias(f"{u}{n}")
                           for u in ("r", "h") for n in range(1, fixed.BLEU_MAX_ORDER + 1)))


def _local_chars(d: DataFrame) -> DataFrame:
    """A character's code is its code point where all are small, else its place among the
    pair's distinct characters; a pair with too many of them is not counted in its row.
    Codes are packed into one number, first those of 1 to 3 characters, then two of these."""
    limit, local = 1 << CODE_BITS, F.col("local")
    d = d.withColumn("letters", F.when(F.col("alone"), F.array_union("r", "h")))
    d = d.withColumn("small", F.coalesce(F.array_max("letters"), F.lit(0)) < limit)
    d = d.withColumn("local", F.col("alone") & (F.col("small") | (F.size("letters") < limit)))

    def code(u: str) -> Column:
        return F.transform(u, lambda c: F.coalesce(F.when(F.col("small"), c).otherwise(F.array_position("letters", c)),
                                                   F.lit(0)).cast("long"))

    def packed(u: str, first: int, last: int) -> Column:
        """Each ``first``-gram before the ``last``-gram that follows it."""
        fits = F.slice(f"{u}{first}", F.lit(1), F.greatest(F.size(f"{u}1") - (first + last - 1), F.lit(0)))
        return F.transform(fits, lambda x, i: F.shiftleft(x, CODE_BITS * last).bitwiseOR(
            F.coalesce(F.get(f"{u}{last}", i + first), F.lit(0).cast("long"))))

    d = d.select("*", *(F.when(local, code(u)).alias(f"{u}1") for u in ("r", "h")))
    for sizes in ([(1, 1)], [(2, 1)], [(2, 2), (3, 2), (3, 3)]):       # of a layer made from the one before
        d = d.select("*", *(F.when(local, packed(u, *size)).alias(f"{u}{sum(size)}") for u in ("r", "h") for size in sizes))
    return d


def _char_gram(u: Column, i: Column, n: Column) -> list[Column]:
    """A character n-gram (n <= 6) of a code-point array as two longs of three
    21-bit code points each -- an exact, fixed-width key.  Slots past ``n``
    are 0; ``n`` is part of the key, so padding is unambiguous."""
    def cp(j: int) -> Column:
        return F.when(n > j, F.coalesce(F.get(u, i - 1 + j), F.lit(0))).otherwise(F.lit(0)).cast("long")

    def pack(a: int) -> Column:
        return F.shiftleft(cp(a), 42).bitwiseOR(F.shiftleft(cp(a + 1), 21)).bitwiseOR(cp(a + 2))
    return [pack(0), pack(3)]


def no_space(col: str) -> Column:
    """Text with every (Python) whitespace character removed."""
    return F.translate(F.coalesce(F.col(col), F.lit("")), fixed.PY_WHITESPACE, "")


def code_points(text: Column) -> Column:
    """The text's code points as ``array<int>`` (empty for an empty text)."""
    return F.when(F.length(text) == 0, F.array().cast("array<int>")) \
            .otherwise(F.transform(F.split(text, ""), lambda c: F.ascii(c)))


def bleu_formula(hyp_len: Column, ref_len: Column, matches: list[Column],
                 k: float = fixed.BLEU_SMOOTHING_K) -> Column:
    """Closing BLEU formula over per-order clipped matches."""
    max_n = len(matches)
    log_terms = []
    zeros_before = F.lit(0)
    for n, m in enumerate(matches, start=1):
        denom = F.greatest(hyp_len - (n - 1), F.lit(1)).cast("double")
        j = zeros_before + 1
        smoothed = (F.lit(1.0) / (F.pow(F.lit(2.0), j) * F.lit(k) / F.log(hyp_len.cast("double")))) / denom
        p = F.when(m > 0, m.cast("double") / denom) \
             .when(hyp_len > 1, smoothed) \
             .otherwise(F.lit(0.0))
        log_terms.append(F.when(p > 0, F.lit(1.0 / max_n) * F.log(p)).otherwise(F.lit(0.0)))
        zeros_before = zeros_before + F.when(m == 0, 1).otherwise(0)
    s = log_terms[0]
    for t in log_terms[1:]:
        s = s + t
    bp = F.when(hyp_len > ref_len, F.lit(1.0)) \
          .when(hyp_len == 0, F.lit(0.0)) \
          .otherwise(F.exp(F.lit(1.0) - ref_len.cast("double") / hyp_len.cast("double")))
    return F.when((hyp_len == 0) | (matches[0] == 0), F.lit(0.0)).otherwise(bp * F.exp(s))


def chrf_formula(hyp_len: Column, ref_len: Column, matches: list[Column],
                 beta: float = fixed.CHRF_BETA) -> Column:
    """Closing chrF formula (0..1) over per-order matches."""
    factor = beta * beta
    sum_p, sum_r, eff = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n, m in enumerate(matches, start=1):
        nh = F.greatest(hyp_len - (n - 1), F.lit(0))
        nr = F.greatest(ref_len - (n - 1), F.lit(0))
        both = (nh > 0) & (nr > 0)
        sum_p = sum_p + F.when(both, m.cast("double") / nh).otherwise(0.0)
        sum_r = sum_r + F.when(both, m.cast("double") / nr).otherwise(0.0)
        eff = eff + F.when(both, 1).otherwise(0)
    p = F.when(eff > 0, sum_p / eff).otherwise(0.0)
    r = F.when(eff > 0, sum_r / eff).otherwise(0.0)
    return F.when(p + r > 0, (1 + factor) * p * r / (factor * p + r)).otherwise(F.lit(0.0))


def bleu_pairs(pairs: DataFrame, ids: list[str], reference: str, candidate: str,
               out: str = "bleu") -> DataFrame:
    """M1: per-pair sentence BLEU of ``candidate`` against ``reference``."""
    n = fixed.BLEU_MAX_ORDER
    st = _ngram_stats(pairs, ids, reference, candidate, _token_hashes, n, _token_gram, _local_tokens, skip=True)
    return st.select(*ids, bleu_formula(F.col("hyp_len"), F.col("ref_len"),
                                        [F.col(f"m{k}") for k in range(1, n + 1)]).alias(out))


def chrf_pairs(pairs: DataFrame, ids: list[str], reference: str, candidate: str,
               out: str = "chrf") -> DataFrame:
    """M2: per-pair sentence chrF (character 1..6-grams, beta 2, 0..1)."""
    n = fixed.CHRF_CHAR_ORDER
    st = _ngram_stats(pairs, ids, reference, candidate, lambda t: code_points(no_space(t)), n, _char_gram, _local_chars)
    return st.select(*ids, chrf_formula(F.col("hyp_len"), F.col("ref_len"),
                                        [F.col(f"m{k}") for k in range(1, n + 1)]).alias(out))


def average_metric(scored: DataFrame, col: str = "bleu", out: str = "avg_bleu") -> DataFrame:
    """M3: number of pairs and arithmetic mean (0 for no pairs)."""
    return scored.agg(F.count(F.lit(1)).alias("n_pairs"),
                      F.coalesce(F.avg(col), F.lit(0.0)).alias(out))
