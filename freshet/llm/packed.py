"""Texts compressed for a shuffle: documents travel to their findings, not the findings to every executor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import doc_key, slices

DOC = "id long, k long, t long, z binary"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (as given), k and t (the key of ``doc_key``) and the text."""
    k, t = doc_key(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), k.alias("k"), t.alias("t"), F.col(text_col).alias("text"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in slices(batch, "text"):
            z = [pack((x.as_py() or "").encode()) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("k"), part.column("t"), pa.array(z, pa.binary())], ["id", "k", "t", "z"])


def squeezed(docs: DataFrame) -> DataFrame:
    """``keyed`` documents with the text compressed."""
    return docs.mapInArrow(_squeeze, DOC)


def bundle(**columns: np.ndarray) -> bytes:
    """Number columns of one length as one compressed value."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns.values()), 1)


def unbundle(value: bytes, n: int) -> list[np.ndarray]:
    """The columns of a bundle of ``n`` columns."""
    data = np.frombuffer(zstandard.decompress(value), np.uint8)
    return [np.ascontiguousarray(c.reshape(8, -1).T).view(np.int64).ravel() for c in data.reshape(n, -1)] if len(data) else [np.zeros(0, np.int64)] * n
