"""The corpus pipeline: five stages from raw documents to shards.

Each stage is ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeeval.llm import decontaminate, minhash, mixing, quality, sharding
from codeeval.llm.queries import quality_weights
from codeeval.llm.tables import maybe_in, possible, saved, table

#: Least Jaccard similarity, in hundredths, of near copies in this pipeline (0.85 is op1_minhash's own).
NEAR = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL cannot express boosted trees or bin packing; tests hold the stages against brute force.
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, which names a row by its doc_id and text.  Stages decide
    by it, so rows that share a doc_id, or have none, are judged each by its own
    text.  Rows with the same name are equal in all that a stage looks at."""
    return _documents(docs).withColumn("row", F.xxhash64("doc_id", "text"))


def _judged(rows: DataFrame, *columns: str) -> DataFrame:
    """Input of an operator that knows rows by doc_id."""
    return rows.select(F.col("row").alias("doc_id"), "text", *columns)


def _without(rows: DataFrame, dropped: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``rows`` without those of ``dropped(row)``; of those of ``once(row)`` one stays.
    Rows that the bit table of both clears pass where they are read; only the others
    meet the exact join, so the texts that stay are not shuffled for it."""
    told = dropped.select("row", F.lit(0).alias("stay"))
    if once is not None:
        told = told.union(once.select("row", F.lit(1)))
    told = saved(told.distinct(), "told")
    marked = maybe_in(rows, "row", told.select("row"), "named")
    met = marked.where("named").join(told, "row", "left")
    out = marked.where("NOT named").select(*COLUMNS).union(met.where("stay IS NULL").select(*COLUMNS))
    return out if once is None else out.union(met.where("stay = 1").dropDuplicates(["row"]).select(*COLUMNS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (operator 9); each row is
    scored and passed on where it is read, so nothing is shuffled for it."""
    forest = quality.fit(quality.statistics(docs), quality.learnable(table(spark, sf_dir, "labels")))
    return quality.passing(_documents(docs), forest)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more), the one
    of the smallest doc_id (null last); of equal rows one (operator 1).  Documents
    without words have no copies and stay."""
    rows = _rows(docs)
    near = saved(minhash.near_duplicates(_judged(rows), NEAR).where("n_shingles > 0")
                 .select(F.col("doc_id").alias("row"), "component_id"), "near")
    ids = rows.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    members = saved(near.distinct().join(ids, "row"), "groups")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    first = saved(members.select("row", "n").join(first, "row"), "first")
    return _without(rows, members.select("row").join(first.select("row"), "row", "left_anti"), first.where("n > 1"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark (operator 2)."""
    rows = _rows(docs)
    found = decontaminate.decontaminate(_judged(rows), table(spark, sf_dir, "benchmark")).where("contaminated")
    return _without(rows, found.select(F.col("doc_id").alias("row")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document once per time that the
    mix takes it, in whole (operator 3).  Equal rows are taken as often as the mix
    takes them together.  Documents without words, which no word budget takes, are
    left out of the mix."""
    rows = _rows(docs)
    weights = (rows.select("row", "doc_id").join(quality_weights(table(spark, sf_dir, "labels")), "doc_id")
               .select(F.col("row").alias("doc_id"), "weight"))
    taken = mixing.mix_sources(_judged(rows, "source"), weights, whole_documents=True).where("size > 0")
    per = taken.groupBy(F.col("doc_id").alias("row")).agg(F.sum(F.col("taken") / F.col("size")).cast("long").alias("t"),
                                                         F.count("*").alias("n"))
    times = saved(per.where("t > 0").select("row", F.floor(F.col("t") / F.col("n")).cast("int").alias("each"),
                                            (F.col("t") % F.col("n")).cast("int").alias("more")), "times")
    # `times` has a row for nearly every document, so it is never broadcast.
    every = (rows.join(times.where("each > 0").hint("merge"), "row")
             .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("each")))).select(*COLUMNS))
    odd = saved(times.where("more > 0"), "odd")             # equal rows only
    rest = (possible(rows, "row", odd.select("row")).join(odd, "row").dropDuplicates(["row"])
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("more")))).select(*COLUMNS))
    return every.union(rest)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix (operator 10)."""
    return sharding.shard(docs, 40)


STAGES = [("quality", good_quality), ("near_duplicates", without_near_copies), ("benchmark", without_benchmark),
          ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
