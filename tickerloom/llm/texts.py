"""Arrow-batched Python over a text column; the other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bound_batches, released


def with_columns(df: DataFrame, fn: Callable[[list], dict[str, Sequence]], fields: str, column: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless given) and the columns that ``fn`` makes of a batch of ``column``.

    ``fields`` is the DDL of the new columns; the names in ``keep`` must differ from them.
    """
    bound_batches(df.sparkSession)
    keep = list(df.columns if keep is None else keep)
    new = T.StructType.fromDDL(fields)
    schema = T.StructType([df.schema[n] for n in keep] + new.fields)
    kinds = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(batch.column(column).to_pylist())
            arrays = [batch.column(n) for n in keep] + [pa.array(made[f.name], type=f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *kinds.names])

    return df.mapInArrow(released(run), schema)


def made_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Sequence]], fields: str) -> DataFrame:
    """Any number of rows of ``fields`` (DDL) from each batch of ``df``, given as lists by column."""
    bound_batches(df.sparkSession)
    schema = T.StructType.fromDDL(fields)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch.to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(released(run), schema)
