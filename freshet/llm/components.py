"""Connected components by alternating stars; every round is a grouping and a join, written to the shared folder.

Edges that fit one task are done there at once: rounds of shuffles over a few rows would only cost their start-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import settled

# edges that one task may hold; more of them go in rounds
TASK_EDGES = 1 << 18


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: every node that is not the root itself, and the least node that it reaches."""
    some = [batch for batch in batches if batch.num_rows]
    if not some:
        return
    table = pa.Table.from_batches(some)
    coded = pa.concat_arrays([table.column(c).combine_chunks() for c in ("a", "b")]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    a, b = rank[coded.indices.to_numpy()].reshape(2, -1)
    root, last = np.arange(len(order)), None
    # roots of linked nodes hang themselves below the lesser one, until no edge has two roots
    while last is None or (root != last).any():
        last, low = root.copy(), np.minimum(root[a], root[b])
        for end in (last[a], last[b]):
            np.minimum.at(root, end, low)
        while (root != root[root]).any():
            root = root[root]
    nodes, own = coded.dictionary.take(order), np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([nodes.take(pa.array(own)), nodes.take(pa.array(root[own]))], ["a", "b"])


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    links = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
    return links.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge that is not the root itself; the root is the least node reachable.

    Nodes can be of any type with an order. Loops and repeated edges do no harm; null ends are left out. A node with
    many edges is one row per edge in the joins, which adaptive execution splits.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a != b")
    now = settled(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= TASK_EDGES:
        kind = now.schema["a"].dataType.simpleString()
        return settled(now.coalesce(1).mapInArrow(_stars, f"a {kind}, b {kind}"), "stars").select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = after
        now = settled(_small(_large(now)), "stars")
