"""a user's function over batches of texts, such as a tokenizer's batched call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_text_batches(df: DataFrame, fn: Callable[[list], list], text: str, out: str, out_type: str) -> DataFrame:
    """``df`` with a column ``out`` of type ``out_type``: ``fn`` is called once per Arrow
    batch with the batch's texts (null is None) and returns one value for each.  It is
    not called for an empty batch; another number of values is an error."""
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, *spark.createDataFrame([], f"`{out}` {out_type}").schema.fields])
    from pyspark.sql.pandas.types import to_arrow_type
    kind = to_arrow_type(schema[out].dataType)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = fn(batch.column(at).to_pylist())
            if len(values) != batch.num_rows:
                raise ValueError(f"{batch.num_rows} texts gave {len(values)} values")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def whitespace_tokens(texts: list) -> list:
    """A plain batched tokenizer: words between white space; null has none."""
    return [(t or "").split() for t in texts]
