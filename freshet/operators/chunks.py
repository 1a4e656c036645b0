"""User functions over chunks of pending rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK_KEYS = ["consumer", "feed", "chunk_id"]


def process_chunks(
    rows: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: dict[str, str],
    keys: list[str] = CHUNK_KEYS,
) -> DataFrame:
    """Run a pandas function over every chunk and merge its partial results.

    ``fn`` sees bounded pieces of one chunk at a time and returns rows with the columns of ``schema``
    (a DDL string, without the keys). ``merge`` names the aggregate that puts each column's partial
    values together, for example ``{"qty": "sum", "first": "min"}``. Rows stay where they are, sorted by chunk within their
    partition: only partial results are shuffled. Pieces are Arrow batches, so a chunk of any size fits.
    """
    fields = StructType.fromDDL(schema)
    if set(merge) != set(fields.names):
        raise ValueError(f"merge must name an aggregate for each of {fields.names}")
    names = [*keys, *fields.names]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values, piece in batch.groupby(keys, dropna=False, sort=False):
                result = fn(piece)
                for key, value in zip(keys, values, strict=True):
                    result[key] = value
                yield result[names]

    out = StructType([*[rows.schema[k] for k in keys], *fields])
    # sorted, so that an Arrow batch meets few chunks
    partial = rows.sortWithinPartitions(*keys).mapInPandas(pieces, out)
    return partial.groupBy(*keys).agg(*[getattr(F, how)(name).alias(name) for name, how in merge.items()])


def chunks_in_order(
    rows: DataFrame, step: Callable[[DataFrame, int], None], chunk: str = "chunk_id"
) -> int:
    """One job per chunk number, oldest first: ``step(rows of chunk i of every edge, i)``.

    Only the largest chunk number comes to the driver. Returns how many steps ran; the first
    failing step ends the loop.
    """
    last = rows.agg(F.max(chunk)).first()[0]
    total = 0 if last is None else int(last) + 1
    for number in range(total):
        step(rows.where(F.col(chunk) == number), number)
    return total
