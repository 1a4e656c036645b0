"""Substring dedup over word windows by super-k-mers.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash among its word 4-grams, with frequent
4-grams ranked behind all others, so that a window belongs to a frequent one only if it has nothing rarer. Consecutive
windows that share a minimiser are one packed string, which travels once to the bucket of that minimiser. Equal windows
have equal minimisers, so a bucket sees every occurrence that matters and counts windows exactly: it sorts them by
hash in document order and compares neighbouring bytes.

A packed string that repeats within a task is sent once, for its earliest place; its later places are known to be
repeats already. So a passage that a third of all documents share reaches its bucket once per task, not once per
document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import IS_SPACE, equal_spans, gather, grams, hash_spans, mix, padded, ranges, raw, runs, slices, sliding_min, words
from freshet.llm.packed import bundle, keyed, squeezed, unbundle

WINDOW = 20
GRAM = 4
# a 4-gram with more than one in HOT_SHARE of all places is frequent; there are at most HOT_SHARE of these
HOT_SHARE = 50_000
# packed bytes per bucket; the number of buckets follows the bytes counted
BUCKET_BYTES = 12 << 20
MAP_BYTES = 4 << 20
TASK_MEMORY = 50_000  # packed strings of frequent minimisers that a task remembers; more are only sent again

_TOP = np.uint64(1 << 63)
_ONE = np.uint64(1)
_NEWLINE = 10


def _grams_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Word bytes joined by one space, word starts and ends, words per row, and hashes of words."""
    data, offsets = raw(part.column("text"))
    ws, we, wo = words(data, offsets)
    if len(ws) and (ws[1:] - we[:-1] != 1).any():
        size = we - ws
        joined, at = np.full(int(size.sum()) + len(ws), 32, np.uint8), np.concatenate(([0], np.cumsum(size + 1)))
        joined[ranges(at[:-1], size)] = data[ranges(ws, size)]
        data, ws, we = joined, at[:-1], at[1:] - 1
    else:
        data = np.where(IS_SPACE[data], np.uint8(32), data)
    room = padded(data)
    return room, ws, we, wo, hash_spans(room, ws, we)


def _count_frequent(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """4-grams that are frequent within a slice, with counts; under a null hash the numbers of places and bytes."""
    places = size = 0
    for batch in batches:
        for part in slices(batch, "text", MAP_BYTES):
            room, ws, _, _, h = _grams_of(part)
            found, n = np.unique(grams(h, min(GRAM, window)), return_counts=True)
            often = n >= max(8, len(ws) // (2 * HOT_SHARE))
            places, size = places + len(ws), size + len(room)
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(n[often], pa.int64()), pa.nulls(int(often.sum()), pa.int64())], ["gram", "n", "size"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([places], pa.int64()), pa.array([size], pa.int64())], ["gram", "n", "size"])


class _Frequent:
    """Membership in a sorted list of hashes, behind a bitmap that turns nearly all others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.hashes & np.uint64(0xFFFFF)] = True

    def holds(self, values: np.ndarray) -> np.ndarray:
        out = self.map[values & np.uint64(0xFFFFF)]
        if len(self.hashes):
            maybe = np.flatnonzero(out)
            at = np.minimum(np.searchsorted(self.hashes, values[maybe]), len(self.hashes) - 1)
            out[maybe] = self.hashes[at] == values[maybe]
        return out


def _pack(batches: Iterator[pa.RecordBatch], window: int, buckets: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers by bucket: key and first word of each, and their text; repeats within the task without text."""
    gram, hot, sent = min(GRAM, window), _Frequent(frequent), {}
    for batch in batches:
        for part in slices(batch, "text", MAP_BYTES):
            room, ws, we, wo, h = _grams_of(part)
            k, t = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t"))
            row = np.repeat(np.arange(part.num_rows), np.diff(wo))
            n = len(ws) - window + 1
            if n <= 0:
                continue
            g = grams(h, gram)
            least = sliding_min((g >> _ONE) | (hot.holds(g).astype(np.uint64) * _TOP), window - gram + 1)
            whole = row[:n] == row[window - 1 :]
            new = np.ones(n, bool)
            new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
            first = np.flatnonzero(whole & new)
            # a run ends before the next one, or where windows leave the document
            last = np.flatnonzero(whole & np.concatenate((new[1:] | ~whole[1:], [True])))
            if not len(first):
                continue
            start, end = ws[first], we[last + window - 1]
            total = np.concatenate(([np.uint64(0)], np.cumsum(g)))
            look = mix(total[last + window - gram + 1] - total[first]) ^ g[first]

            # equal strings of this slice, earliest place first
            place = np.empty(part.num_rows, np.int64)
            place[np.lexsort((t, k))] = np.arange(part.num_rows)
            order = np.lexsort((first, place[row[first]], look))
            a, b = order[1:], order[:-1]
            same = (look[a] == look[b]) & (end[a] - start[a] == end[b] - start[b])
            same[same] = equal_spans(room, start[a[same]], start[b[same]], (end - start)[a[same]])
            again, twin = np.zeros(len(first), bool), np.zeros(len(first), bool)
            again[a[same]] = True
            # a row that repeats identifier and text is the same document: nothing of it is said twice
            word = first - wo[row[first]]
            key_of = [x[row[first]] for x in (k, t)]
            twin[a[same]] = (word[a] == word[b])[same] & (key_of[0][a] == key_of[0][b])[same] & (key_of[1][a] == key_of[1][b])[same]
            # ... and of earlier slices, for frequent minimisers
            for i in np.flatnonzero((least[first] >= _TOP) & ~again):
                text, own = room[start[i] : end[i]].tobytes(), (key_of[0][i], key_of[1][i], word[i])
                known = sent.get(text)
                if known is not None and known <= own:
                    again[i], twin[i] = True, known == own
                elif known is not None or len(sent) < TASK_MEMORY:
                    sent[text] = own

            count = last - first + window
            out: list[tuple[int, bytes, bytes | None]] = []
            if (told := again & ~twin).any():
                r = row[first[told]]
                out.append((int(k[r[0]] % buckets), bundle(k=k[r], t=t[r], word=word[told], count=count[told]), None))
            bucket = (mix(least[first].copy()) % np.uint64(buckets)).astype(np.int64)
            sends = np.flatnonzero(~again)
            sends = sends[np.argsort(bucket[sends], kind="stable")]
            for own in np.split(sends, np.flatnonzero(np.diff(bucket[sends])) + 1):
                text, at = gather(room, start[own], end[own] + 1)
                text[at[1:] - 1] = _NEWLINE
                r = row[first[own]]
                out.append((int(bucket[own[0]]), bundle(k=k[r], t=t[r], word=word[own], count=count[own]), zstandard.compress(text, 3)))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["bucket", "places", "strings"])


def _exactly(room: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the windows in order repeat an earlier one, by their bytes; for hashes that collided."""
    seen: dict[bytes, tuple] = {}
    return np.array([seen.setdefault(room[starts[p] : ends[p]].tobytes(), own) != own for p, own in zip(order, map(tuple, place.T.tolist()))], bool)


def _count_windows(table: pa.Table, window: int) -> pa.Table:
    """Word ranges of one bucket that are covered by windows which also start earlier."""
    places, texts, known = [], [], []
    for p, s in zip(table.column("places").to_pylist(), table.column("strings").to_pylist()):
        if s is None:
            known.append(np.stack(unbundle(p, 4)))
        else:
            places.append(np.stack(unbundle(p, 4)))
            texts.append(zstandard.decompress(s))
    found = []
    if known:
        k, t, word, count = np.concatenate(known, axis=1)
        found.append(np.stack((k, t, word, word + count)))
    if texts:
        k, t, word, _ = np.concatenate(places, axis=1)
        data = np.frombuffer(b"".join(texts), np.uint8)
        room = padded(data)
        ws, we, _ = words(data, np.array([0, len(data)]))
        wo = np.searchsorted(ws, np.concatenate(([0], np.flatnonzero(data == _NEWLINE) + 1)))
        order = np.lexsort((word, t, k))
        counts = np.diff(wo)[order] - window + 1
        at = ranges(wo[order], counts)
        g = grams(hash_spans(room, ws, we), window)[at]
        by = np.argsort(g, kind="stable")
        equal = np.flatnonzero(g[by[1:]] == g[by[:-1]])
        later, earlier = by[equal + 1], by[equal]
        a, b = at[later], at[earlier]
        size = we[a + window - 1] - ws[a]
        right = size == we[b + window - 1] - ws[b]
        right[right] = equal_spans(room, ws[a[right]], ws[b[right]], size[right])
        own = np.repeat(np.arange(len(order)), counts)
        heads = np.concatenate(([0], np.cumsum(counts)[:-1]))
        # a window repeats the first of its equals, unless it is at the same place: then rows are repeated
        begins = np.ones(len(at), bool)
        begins[equal + 1] = False
        leader = np.empty(len(at), np.int64)
        leader[by] = by[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        place = np.stack((k[order][own], t[order][own], word[order][own] + np.arange(len(at)) - heads[own]))
        repeat = (place != place[:, leader]).any(axis=0)
        for value in np.unique(g[later[~right]]):
            some = np.flatnonzero(g == value)
            repeat[some] = _exactly(room, ws, np.append(we[window - 1 :], [0] * (window - 1)), at[some], place[:, some])
        # runs of repeated windows, not across strings
        gap = np.zeros(len(at) + len(order), bool)
        gap[np.arange(len(at)) + own] = repeat
        s, e = runs(gap)
        r = own[s - np.searchsorted(heads + counts + np.arange(len(order)), s, "right")]
        lo, hi = s - heads[r] - r, e - heads[r] - r
        r = order[r]
        found.append(np.stack((k[r], t[r], word[r] + lo, word[r] + hi - 1 + window)))
    cols = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return pa.table([pa.array(c) for c in cols], names=["k", "t", "s", "e"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for i, z, spans in zip(batch.column("id"), batch.column("z"), batch.column("spans")):
            text = zstandard.decompress(z.as_py()).split()
            kept, at, cut = [], 0, []
            for x in sorted((x["s"], x["e"]) for x in spans.as_py() or ()):
                if cut and x[0] <= cut[-1][1]:
                    cut[-1] = (cut[-1][0], max(cut[-1][1], x[1]))
                else:
                    cut.append(x)
            for s, e in cut:
                kept += text[at:s]
                at = e
            kept += text[at:]
            rows.append((i.as_py(), len(text), len(text) - len(kept), [{"s": s, "e": e} for s, e in cut], b" ".join(kept).decode()))
            held += len(rows[-1][-1])
            if held > MAP_BYTES:
                yield _cut_batch(rows)
                rows, held = [], 0
        if rows:
            yield _cut_batch(rows)


def _cut_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["id", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans (removed word ranges) and kept_text.

    Words are separated by white space. A word goes if a window that covers it also starts earlier: in a document
    with a smaller identifier, or earlier in the same one. A null text has no words; a null identifier comes last.
    Rows that repeat identifier and text are one document and get the same result; different texts under one
    identifier are ordered by a hash of the text. Texts shorter than a window stay. Other columns are ignored.
    """
    read = keyed(docs, id_col, text_col)
    texts = read.select("k", "t", "text")
    counted = texts.select("text").mapInArrow(partial(_count_frequent, window=window), "gram long, n long, size long")
    sums = counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    whole = sums.where("gram IS NULL").first()
    places, size = (whole["n"], whole["size"]) if whole else (0, 0)
    frequent = np.array([r[0] for r in sums.where(F.col("gram").isNotNull() & (F.col("n") * HOT_SHARE > places)).select("gram").collect()], np.int64)
    buckets = max(1, -(-3 * size // bucket_bytes))

    strings = texts.mapInArrow(partial(_pack, window=window, buckets=buckets, frequent=frequent.view(np.uint64)), "bucket long, places binary, strings binary")
    spans = strings.groupBy("bucket").applyInArrow(lambda group: _count_windows(group, window), "k long, t long, s long, e long")
    by_doc = spans.groupBy("k", "t").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = squeezed(read).join(by_doc, ["k", "t"], "left").select("id", "z", "spans")
    out = joined.mapInArrow(_cut, "id long, n_words long, n_removed long, spans array<struct<s: long, e: long>>, kept_text string")
    return out.withColumnRenamed("id", id_col)
