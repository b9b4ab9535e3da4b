"""codeeval: DataFrame -> DataFrame operators for building and judging
instruction-to-code datasets on Spark.

Layout
------
``sources``    readers and writers (JSON / JSON Lines / text folders / parquet)
``functions``  column expressions (text cleaning, hashing, labels, fixed values)
``operators``  DataFrame -> DataFrame operators (pairing, dedup, scoring, rollups ...)
``plans``      the registered queries over the driver tables and their SQL oracles
``streaming``  Structured Streaming form of the incremental dedup
"""

__all__ = ["session"]
