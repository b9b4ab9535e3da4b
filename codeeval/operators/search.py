"""P9 for many terms at once: an inverted index of character n-grams.

Of each text the distinct grams of ``GRAM`` characters are its entries.  A term can only
be in texts that hold all grams of the term, so the postings of a term's grams are
intersected (counted by term and text), and the few candidates left are compared with
``contains``, a conversation's all at once.  A term of up to ``GRAM`` characters is a gram
itself, which needs no comparison: grams of one and two characters are entered too.  Only entries that some term
asks for are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pairs import pair_positional

GRAM = 3


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text, in one pass over its characters."""
    def runs(chars: Column) -> Column:      # bound once: not split again for every character
        return F.array_distinct(F.array_compact(
            F.transform(chars, lambda c, i: F.concat(c, *(F.get(chars, i + j) for j in range(1, size))))))

    chars = F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(chars), runs))


def _term_grams(term: Column) -> Column:
    n = F.length(term)
    return F.when(n >= GRAM, grams(term, GRAM)).otherwise(F.array(term))


def term_index(texts: DataFrame, ids: list[str], text: str) -> DataFrame:
    """``(ids..., gram)``: the entries of each text, lower-cased."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    every = F.array_union(F.array_union(grams(low, 1), grams(low, 2)), grams(low, GRAM))
    return texts.select(*ids, F.explode(every).alias("gram"))


def search_terms(messages: DataFrame, terms: DataFrame) -> DataFrame:
    """P9 for every term of ``terms(term)``: ``(term, conv_id, preview)`` of the
    conversations whose message[0] or message[1] holds it, case-insensitively.  Terms are
    stripped and lower-cased, and equal ones asked once; a blank or null one is an error."""
    asked = terms.select(F.lower(T.ustrip(F.coalesce(F.col("term"), F.lit("")))).alias("term")).distinct()
    asked = asked.select(F.when(F.col("term") == "", F.raise_error(F.lit("a search term is blank")).cast("string"))
                         .otherwise(F.col("term")).alias("term"))
    wanted = asked.select("term", _term_grams(F.col("term")).alias("g"))
    wanted = wanted.select("term", F.size("g").alias("n"), F.explode("g").alias("gram"))
    pos = pair_positional(messages)
    sides = pos.select("conv_id", F.inline(F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("text"))
                                                    for s in ("prompt", "reference"))))).where("text IS NOT NULL")
    found = (term_index(sides, ["conv_id", "side"], "text").join(wanted, "gram")
             .groupBy("term", "conv_id", "side").agg(F.count("*").alias("have"), F.first("n").alias("n")).where("have = n"))
    # a conversation's candidates meet its texts once; a term that is a gram is found for certain
    listed = found.groupBy("conv_id").agg(F.collect_list(F.struct("term", "side")).alias("found"))
    low = pos.select("conv_id", T.preview("prompt").alias("preview"), *(F.lower(s).alias(s) for s in ("prompt", "reference")))

    def holds(x: Column) -> Column:
        return (F.length(x["term"]) <= GRAM) | F.when(x["side"] == "prompt", F.contains("prompt", x["term"])) \
            .otherwise(F.contains("reference", x["term"]))

    hits = F.array_distinct(F.transform(F.filter("found", holds), lambda x: x["term"]))
    return listed.join(low, "conv_id").select(F.explode(hits).alias("term"), "conv_id", "preview")
