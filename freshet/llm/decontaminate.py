"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). As a set of word
3-grams it is contained in a document only if its rarest 3-gram is, so that one token is the prefix that has to be
joined. Tokens are ordered by their exact counts over all documents. A matched token fixes where the window would
have to lie; length and position rule out what does not fit, and the words at that place are compared in full.

Documents are filtered by a bitmap of fixed size before the join; the benchmark itself is never broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import IS_BREAK, LOWER, gather, grams, hash_spans, padded, ranges, raw, slices, words
from freshet.llm.packed import keyed
from freshet.session import settled

WINDOW = 10
GRAM = 3
# bytes of text whose words are held at once, which takes many times as many bytes of memory
SLICE_BYTES = 1 << 20
MAP_BITS = 22  # the bitmap has a fixed size, whatever the benchmark's; a full one only filters less


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    data, offsets = raw(part.column("text"))
    data = LOWER[data]
    ws, we, wo = words(data, offsets, IS_BREAK)
    room = padded(data)
    return room, ws, we, wo, hash_spans(room, ws, we)


def _joined(room: np.ndarray, ws: np.ndarray, we: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.Array:
    """Word ranges as strings, with one space after every word."""
    own = ranges(first, count)
    data, at = gather(room, ws[own], we[own] + 1)
    data[at[1:] - 1] = 32
    ends = at[np.concatenate(([0], np.cumsum(count)))]
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of every item, each with its tokens and their offsets."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            room, ws, we, wo, h = _words(part)
            n = np.diff(wo)
            size = np.minimum(n, WINDOW)
            many = np.where(n > 0, n - size + 1, 0)
            row = np.repeat(np.arange(part.num_rows), many)
            first, size = ranges(wo[:-1], many), size[row]
            tokens: list = [[]] * len(first)
            for length in np.unique(size):
                g = grams(h, min(GRAM, int(length))).view(np.int64)
                of = np.flatnonzero(size == length)
                grid = first[of][:, None] + np.arange(max(1, length - GRAM + 1))
                for i, values in zip(of, g[grid].tolist()):
                    tokens[i] = values
            items = part.column("id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([items, _joined(room, ws, we, first, size), pa.array(size, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["item", "w", "n", "tokens"])


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """Which low bits occur among tokens; at most 2 ** MAP_BITS numbers reach the driver."""
    bits = np.zeros(1 << MAP_BITS, bool)
    low = tokens.select(F.col("token").bitwiseAND((1 << MAP_BITS) - 1).cast("int").alias("b")).distinct().toPandas()
    bits[low["b"].to_numpy(np.int64)] = True
    return np.packbits(bits)


class _Grams:
    """Finds the tokens of a slice of documents that pass the bitmap."""

    def __init__(self, bits: np.ndarray, lengths: list[int]):
        self.bits, self.lengths = np.unpackbits(bits).astype(bool), lengths

    def find(self, h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and their first words."""
        row = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
        tokens, places = [], []
        for q in self.lengths:
            g = grams(h, q)
            at = np.flatnonzero(self.bits[g & np.uint64((1 << MAP_BITS) - 1)])
            at = at[row[at] == row[at + q - 1]]
            tokens.append(g[at].view(np.int64))
            places.append(at)
        return np.concatenate(tokens), np.concatenate(places)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted as strings), spans (covered word ranges).

    Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case. A word is hit if it lies
    in an occurrence of a window. Null texts have no words; an item without words has no windows; an item with a null
    id has windows but is not listed; items that repeat an id are one. Rows of ``docs`` that repeat id and text get
    the same result. An empty benchmark hits nothing. Other columns are ignored. ``with_key`` adds k and t, the key of ``doc_key``.
    """
    read = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    listed = settled(read.mapInArrow(_windows, "item string, w string, n long, tokens array<long>"), "windows")
    windows = listed.groupBy("w", "n").agg(F.first("tokens").alias("tokens"))
    tokens = windows.select("w", "n", F.posexplode("tokens").alias("offset", "token"))
    lengths = [r[0] for r in listed.select(F.least("n", F.lit(GRAM)).alias("q")).distinct().collect()]  # of 1 to GRAM
    keys = keyed(docs, id_col, text_col)

    # how often every token of the benchmark occurs in all documents
    look = _Grams(_bitmap(tokens), lengths or [GRAM])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                _, _, _, wo, h = _words(part)
                found, n = np.unique(look.find(h, wo)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n, pa.int64())], ["token", "n"])

    counts = keys.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("seen"))
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "offset")).alias("p")
    prefixes = settled(tokens.join(counts, "token", "left").groupBy("w", "n").agg(rarest).select("w", "n", "p.token", "p.offset", "p.seen"), "prefixes")

    # a prefix that no document has rules its window out
    occurring = prefixes.where("seen > 0")
    want = _Grams(_bitmap(occurring), lengths or [GRAM])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "k", "t", "n_words", "token", "at", "lo", "context"]
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                room, ws, we, wo, h = _words(part)
                n, none = np.diff(wo), pa.nulls(part.num_rows, pa.int64())
                keys_of = [part.column(c) for c in ("id", "k", "t")]
                yield pa.RecordBatch.from_arrays([*keys_of, pa.array(n, pa.int64()), none, none, none, pa.nulls(part.num_rows, pa.string())], names)
                token, at = want.find(h, wo)
                if not len(at):
                    continue
                row = np.searchsorted(wo, at, "right") - 1
                lo, hi = np.maximum(at - WINDOW, wo[row]), np.minimum(at + WINDOW, wo[row + 1])
                context, take = _joined(room, ws, we, lo, hi - lo), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(take) for c in keys_of), pa.array(n[row], pa.int64()), pa.array(token), pa.array(at - wo[row]), pa.array(lo - wo[row]), context], names
                )

    seen = settled(keys.mapInArrow(candidates, "id long, k long, t long, n_words long, token long, at long, lo long, context string"), "candidates")
    start = F.col("at") - F.col("offset")
    placed = seen.where("token IS NOT NULL").join(occurring, "token").withColumn("s", start).where("s >= lo AND s >= 0 AND s + n <= n_words")
    there = F.concat(F.array_join(F.slice(F.split("context", " "), (F.col("s") - F.col("lo") + 1).cast("int"), F.col("n").cast("int")), " "), F.lit(" "))
    hits = placed.where(there == F.col("w")).select("k", "t", "s", (F.col("s") + F.col("n")).alias("e"), "w")

    spans = hits.groupBy("k", "t").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    named = listed.where("item IS NOT NULL").select("w", "item").distinct()
    items = hits.select("k", "t", "w").distinct().join(named, "w").groupBy("k", "t").agg(F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
        lambda a: a["n"],
    )
    out = seen.where("token IS NULL").join(spans, ["k", "t"], "left").join(items, ["k", "t"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce(covered, F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s: long, e: long>>")).alias("spans"),
        *(["k", "t"] if with_key else []),
    )
