"""Records of a JSON array of any size, read by many tasks.

A file that is one JSON array has no line to split at, but every record ends with a
closing brace.  So the file is read as text with ``}`` for the line end, which Spark
splits like any other text, and the pieces are put together again:

1. Of each piece, the parity of its quotes and the brackets it opens less those it
   closes, once as if it began outside of a string and once as if inside.
2. Of each split, the same, from prefix sums over its pieces.  One row per split
   goes on: a prefix sum over the splits of a file tells for each whether it begins in
   a string and how deep.
3. With that, a piece ends a record if its brace closes back to the depth of the
   records, outside of strings.  Counts of ends, again per split and then over the
   splits, number the records.
4. Pieces are joined to records within their split; only the record that two splits
   share moves once more.  ``from_json`` parses each record by itself.

The texts cross one exchange, by split, which bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "}"
#: What may stand between records, and after the last.
BETWEEN = r"^[\s,\[]*"
#: The same where parts meet: the brace is the one that each part's last piece is taken to have.
BETWEEN_PARTS = r"^[\s,\[}]*"
AFTER_ARRAY = r"^\s*\]\s*$"
#: The form of an evaluation document up to its first result, and after the last.
DOCUMENT_HEAD = r"(?s)^\s*\{.*?\"detailed_results\"\s*:\s*\[\s*"
AFTER_DOCUMENT = r"(?s)^\s*\].*$"


def _balance(parts: Column, first: int) -> Column:
    """Brackets opened less those closed in every second part (from the ``first`` on)
    of a text cut at its quotes.  Only whole pieces are cut, so none holds a ``}``."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
    return (F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))).cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, piece, odd, out, inside``: what a piece does to quotes and depth,
    its brace included, if it begins outside of a string and if inside."""
    raw = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    odd = (F.size(parts) - 1) % 2
    return raw.select("*", odd.alias("odd"), (_balance(parts, 0) - (1 - odd)).alias("out"), (_balance(parts, 1) - odd).alias("inside"))


def array_records(spark: SparkSession, path: str, ddl: str, rank: list[Column], out: str, one: bool = False) -> DataFrame:
    """Records of single-array files: ``(out, r, _value)``, numbered over all files,
    whose order is that of ``rank`` (columns over ``_file``).  ``one``: the files are parts
    of one array, cut at line ends, as ``writers.write_conversations_array`` leaves them.  A record that does not
    parse has a null ``r`` and its text in ``_value``; so has what is left of a file after its
    last record, if that does not close the array.  Files that begin with ``{`` are
    evaluation documents: their records are the detailed results."""
    split, before = ["file", "start"], Window.unboundedPreceding
    along = Window.partitionBy(*split).orderBy("at").rowsBetween(before, -1)
    quoted = F.coalesce(F.sum("odd").over(along), F.lit(0)) % 2            # in a string, if the split begins outside of one
    d = (_pieces(spark, path).withColumn("q", quoted)
         .withColumn("d0", F.when(F.col("q") == 0, F.col("out")).otherwise(F.col("inside")))
         .withColumn("d1", F.when(F.col("q") == 0, F.col("inside")).otherwise(F.col("out"))))

    # One row per split: does it begin in a string, and how deep?
    splits = d.groupBy(*split).agg(F.sum("odd").alias("odd"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"),
                                   F.max("at").alias("last"), F.min_by(F.substring(F.ltrim("piece"), 1, 1), "at").alias("head"))
    splits = splits.withColumn("_file", F.col("file")).select(
        "*", F.struct(*rank).alias("rank"), (F.lit("") if one else F.col("file")).alias("whole"))
    files = Window.partitionBy("whole").orderBy("rank", "start")
    earlier = files.rowsBetween(before, -1)
    # The text after a file's last brace counts as if it ended with one, too.
    phantom = F.dense_rank().over(Window.partitionBy("whole").orderBy("rank")) - 1
    splits = splits.withColumn("s", F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2)
    turned = F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1"))
    splits = splits.select(
        *split, "whole", "rank", "s", (F.coalesce(F.sum(turned).over(earlier), F.lit(0)) + phantom).alias("deep"),
        F.when(F.lead("start").over(files).isNull(), F.col("last")).alias("file_end"),
        F.when(F.first("head").over(files) == "{", 2).otherwise(1).alias("level"))

    # Where records end, and how many did so far.
    so_far = Window.partitionBy(*split).orderBy("at").rowsBetween(before, 0)
    d = d.join(splits, split).withColumn("depth", F.col("deep") + F.sum(
        F.when(F.col("s") == 0, F.col("d0")).otherwise(F.col("d1"))).over(so_far))
    closes = ((F.col("s") + F.col("q") + F.col("odd")) % 2 == 0) & (F.col("depth") == F.col("level")) \
        & ~F.col("at").eqNullSafe(F.col("file_end"))
    d = d.withColumn("ends", closes.cast("int")).withColumn("rec", F.coalesce(F.sum("ends").over(along), F.lit(0)))
    merged = (d.groupBy(*split, "whole", "rank", "rec", "level")
              .agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"), F.max("ends").alias("ends"),
                   F.max(F.col("at").eqNullSafe(F.col("file_end"))).alias("tail"))
              .select(*split, "whole", "rank", "rec", "level", "ends", "tail", F.array_join(F.col("p.piece"), END).alias("text")))

    # A split's first record goes on from the splits before it.
    ends = d.groupBy(*split, "whole", "rank").agg(F.sum("ends").alias("n"))
    upto = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    merged = merged.join(ends.select(*split, upto.alias("base")), split).withColumn("rec", F.col("base") + F.col("rec"))
    alone = (F.col("ends") == 1) & (F.col("rec") > F.col("base"))
    shared = (merged.where(~alone).groupBy("whole", "rec", "level")
              .agg(F.sort_array(F.collect_list(F.struct("rank", "start", "text"))).alias("p"), F.max("ends").alias("ends"), F.max("tail").alias("tail"))
              .select("whole", "rec", "level", "ends", "tail", F.array_join(F.col("p.text"), END).alias("text")))
    texts = merged.where(alone).select(*shared.columns).union(shared).withColumnRenamed("whole", "file")
    return _parsed(texts, ddl, rank, out, BETWEEN_PARTS if one else BETWEEN)


def _parsed(texts: DataFrame, ddl: str, rank: list[Column], out: str, between: str) -> DataFrame:
    """Texts of records (``ends`` = 1) and of what follows the last, parsed and numbered."""
    head = F.when((F.col("level") == 2) & (F.col("rec") == 0), DOCUMENT_HEAD).otherwise(between)
    whole = F.regexp_replace("text", head, F.lit(""))
    after = F.when(F.col("level") == 2, F.lit(AFTER_DOCUMENT)).otherwise(F.lit(AFTER_ARRAY))
    left = F.regexp_replace("text", F.when((F.col("level") == 2) & (F.col("rec") == 0), DOCUMENT_HEAD).otherwise(r"^[\s\[]*"), F.lit(""))
    closed = F.rlike(left, after) | (F.ltrim(F.regexp_replace("text", r"\s+", "")) == "")
    rows = texts.where((F.col("ends") == 1) | ~closed).select(
        "file", "rec", "text", F.when(F.col("ends") == 1, F.from_json(
            F.concat(whole, F.lit(END)), f"{ddl}, _broken string", {"columnNameOfCorruptRecord": "_broken"})).alias("r"))
    good = F.col("r").isNotNull() & F.col("r._broken").isNull()
    counts = rows.groupBy("file").agg(F.count("*").alias("n")).withColumnRenamed("file", "_file")
    offset = F.coalesce(F.sum("n").over(Window.orderBy(*rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(counts.select(F.col("_file").alias("file"), offset.alias("off")), "file")
    return numbered.select((F.col("off") + F.col("rec")).cast("long").alias(out),
                           F.when(good, F.col("r").dropFields("_broken")).alias("r"), F.when(~good, F.col("text")).alias("_value"))
