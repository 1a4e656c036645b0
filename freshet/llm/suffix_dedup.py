"""Byte-level dedup by hash-compared suffix sorting.

A window is ``WINDOW`` bytes of one document. Its anchor is the place of its least ``GRAM``-byte hash, so equal windows have
equal anchors at equal offsets, and windows that share an anchor are one context around it. Only anchors whose hash
occurs again are cut out of their documents and meet in a bucket. There the texts right of the anchors, and those left of
them read backwards, are sorted as suffixes: a mergesort in which two suffixes are compared by the length of their common
extension, found by binary search on prefix polynomial hashes in logarithmic time. Neighbours' common bytes are
verified; a collision repeats the sort under another base. A window at offset o is repeated where another suffix agrees
over o bytes to the left and ``WINDOW`` - o to the right, which is read off the two sorted orders without forming pairs.

Frequent grams rank behind all others, so a passage that many documents share is anchored within itself and its contexts
are equal everywhere; equal contexts of a task are sent once. Text that repeats with a short period is settled at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import equal_spans, gather, mix, padded, raw, slices, sliding_min
from freshet.llm.packed import bundle, keyed, squeezed, unbundle
from freshet.session import settled

WINDOW = 400
GRAM = 100
# A gram is frequent if its cell of a counting table holds more than one in HOT_SHARE of all places: at most HOT_SHARE cells.
CELL_BITS, HOT_SHARE = 22, 200_000
# a key with more than one in HOT_KEYS of all anchors is looked up by itself: at most HOT_KEYS keys
HOT_KEYS = 1000
MAP_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
BASES = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]

_LOW = np.uint64(0xFFFFFFFF)
_CELLS = np.uint64((1 << CELL_BITS) - 1)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


class Prefixes:
    """Polynomial hashes of all prefixes of a text, and from them of any part."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        size = 1 << max(20, int(len(data) + 1).bit_length())
        up, self.down = _powers(base, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def all_parts(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def _count_cells(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    """Cells that are frequent within a task; under a null cell the numbers of grams and bytes."""
    cells, places = np.zeros(1 << CELL_BITS, np.int64), 0
    for batch in batches:
        for part in slices(batch, "text", MAP_BYTES):
            data, _ = raw(part.column("text"))
            if len(data) >= gram:
                cells += np.bincount((Prefixes(data).all_parts(gram) & _CELLS).astype(np.int64), minlength=1 << CELL_BITS)
            places += len(data)
    often = np.flatnonzero(cells > max(16, places // (2 * HOT_SHARE)))
    yield pa.RecordBatch.from_arrays([pa.array([None, *often.tolist()], pa.int64()), pa.array([places, *cells[often].tolist()], pa.int64())], ["cell", "n"])


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per anchor its hash, place and the range [lo, hi) its windows cover; without a hash, ranges known to repeat."""
    frequent = np.zeros(1 << CELL_BITS, bool)
    frequent[hot] = True
    names = ["k", "t", "key", "at", "lo", "hi"]
    for batch in batches:
        for part in slices(batch, "text", MAP_BYTES):
            data, offsets = raw(part.column("text"))
            n = len(data) - window + 1
            if n <= 0:
                continue
            g = Prefixes(data).all_parts(gram)
            rank = (g >> np.uint64(33)) | (frequent[g & _CELLS].astype(np.uint64) << np.uint64(31))
            place = (sliding_min((rank << np.uint64(32)) | np.arange(len(g), dtype=np.uint64), window - gram + 1) & _LOW).astype(np.int64)
            # windows that lie within one row
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            whole = row[:n] == row[window - 1 :]
            k, t = (part.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t"))

            known: list[tuple[int, int]] = []
            seats = np.unique(place[whole])
            if len(seats) > 2:
                # chains of equal grams at one distance: text with a period
                step = np.diff(seats)
                tied = (g[seats[1:]] == g[seats[:-1]]) & (step <= gram) & (row[seats[1:]] == row[seats[:-1]])
                link = np.flatnonzero(tied)
                for chain in np.split(link, np.flatnonzero((np.diff(link) != 1) | (np.diff(step[link]) != 0)) + 1) if len(link) else []:
                    first, end, period = seats[chain[0]], seats[chain[-1] + 1] + gram, step[chain[0]]
                    if end - first >= window + period and (data[first : end - period] == data[first + period : end]).all():
                        known.append((first, end))
                        # windows of two periods stand for all others of the run
                        whole[first + 2 * period + 1 : max(first + 2 * period + 1, end - window + 1)] = False
            head = whole.copy()
            head[1:] &= ~whole[:-1] | (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1])
            tail = whole.copy()
            tail[:-1] &= ~whole[1:] | (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1])
            lo, hi = np.flatnonzero(head), np.flatnonzero(tail) + window
            at = place[lo]
            r = row[lo]
            base = offsets[r]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[r], t[r], g[at].view(np.int64), at - base, lo - base, hi - base)], names)
            if known:
                lo, hi = np.array(known, np.int64).T
                r = row[lo]
                none = pa.nulls(len(r), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(k[r]), pa.array(t[r]), none, none, pa.array(lo - offsets[r]), pa.array(hi - offsets[r])], names)


def _contexts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors by bucket; equal ones of a slice once, the others as ranges known to repeat."""
    names, kinds = ["bucket", "places", "texts"], (pa.int64(), pa.binary(), pa.binary())

    def flush(texts: list[bytes], marks: list[np.ndarray]) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(texts), np.uint8)
        room = padded(data)
        base = np.concatenate(([0], np.cumsum([len(x) for x in texts])[:-1]))
        count = [m.shape[1] for m in marks]
        k, t, key, at, lo, hi = np.concatenate(marks, axis=1)
        shift = np.repeat(base, count)
        start, size = lo + shift, hi - lo
        look = np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + n]) for s, n in zip(start, size)), np.uint64, len(start))
        order = np.lexsort((at - lo, key, size, look))
        a, b = order[1:], order[:-1]
        same = (look[a] == look[b]) & (size[a] == size[b]) & (key[a] == key[b]) & ((at - lo)[a] == (at - lo)[b])
        same[same] = equal_spans(room, start[a[same]], start[b[same]], size[a[same]])
        again, twice = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
        again[a[same]] = True
        twice[b[same]] = 1
        out: list[tuple[int, bytes, bytes | None]] = []
        if again.any():
            own = np.flatnonzero(again)
            out.append((int(k[own[0]] % buckets), bundle(k=k[own], t=t[own], lo=lo[own], hi=hi[own]), None))
        sends = np.flatnonzero(~again)
        bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        sends = sends[np.argsort(bucket[sends], kind="stable")]
        for own in np.split(sends, np.flatnonzero(np.diff(bucket[sends])) + 1):
            text, _ = gather(data, start[own], start[own] + size[own])
            out.append((int(bucket[own[0]]), bundle(k=k[own], t=t[own], key=key[own], at=at[own], lo=lo[own], hi=hi[own], twice=twice[own]), zstandard.compress(text, 3)))
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names)

    texts: list[bytes] = []
    marks: list[np.ndarray] = []
    held = 0
    for batch in batches:
        for k, t, z, anchors in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist(), batch.column("z"), batch.column("anchors")):
            v = anchors.values
            m = np.stack([np.full(len(v), k), np.full(len(v), t), *(v.field(c).to_numpy() for c in ("key", "at", "lo", "hi"))])
            texts.append(zstandard.decompress(z.as_py()))
            marks.append(m)
            held += len(texts[-1])
            if held > 4 * MAP_BYTES:
                yield flush(texts, marks)
                texts, marks, held = [], [], 0
    if texts:
        yield flush(texts, marks)


def common(hashes: Prefixes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common extension of suffixes a and b, up to ``most``, by binary search."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while True:
        todo = np.flatnonzero(lo < hi)
        if not len(todo):
            return lo
        mid = (lo[todo] + hi[todo] + 1) // 2
        equal = hashes.part(a[todo], mid) == hashes.part(b[todo], mid)
        lo[todo[equal]] = mid[equal]
        hi[todo[~equal]] = mid[~equal] - 1


def sort_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders suffixes (of ``size`` bytes) within groups, which must be ascending; also each one's common length with the
    one before it in order (-1 for the first of a group). A bottom-up mergesort of all groups at once."""
    n = len(start)
    room = padded(data)
    head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.append(head, n))
    own_head, own_length = np.repeat(head, length), np.repeat(length, length)
    for base in BASES:
        hashes = Prefixes(data, base)

        def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
            """Whether suffix x sorts before y (or is equal, where ``ties``)."""
            least = np.minimum(size[x], size[y])
            c = common(hashes, start[x], start[y], least)
            over = c == least
            less = room[start[x] + c] < room[start[y] + c]
            return np.where(over, (size[x] < size[y]) | ((size[x] == size[y]) & ties), less)

        order, width = np.arange(n), 1
        while n and width < length.max():
            at = np.arange(n) - own_head
            active = np.flatnonzero(own_length > width)
            block, side = at[active] // (2 * width) * (2 * width), at[active] // width % 2
            # the sibling run, and the rank in it
            other = np.where(side == 0, block + width, block)
            other_end = np.minimum(np.where(side == 0, block + 2 * width, block + width), own_length[active])
            lo, hi = np.minimum(other, own_length[active]), other_end
            begin, me = lo.copy(), order[active]
            while len(todo := np.flatnonzero(lo < hi)):
                mid = (lo[todo] + hi[todo]) // 2
                peer = order[own_head[active[todo]] + mid]
                # of equal suffixes those of the left run come first
                goes = before(peer, me[todo], side[todo] == 1)
                lo[todo[goes]] = mid[goes] + 1
                hi[todo[~goes]] = mid[~goes]
            to = own_head[active] + block + (at[active] - block - side * width) + (lo - begin)
            fresh = order.copy()
            fresh[to] = me
            order, width = fresh, 2 * width
        lcp = np.full(n, -1)
        inner = np.setdiff1d(np.arange(n), head, assume_unique=True)
        x, y = order[inner], order[inner - 1]
        lcp[inner] = common(hashes, start[x], start[y], np.minimum(size[x], size[y]))
        if equal_spans(room, start[x], start[y], lcp[inner]).all():
            return order, lcp
    raise RuntimeError("hash collisions under every base")


def _repeats(table: pa.Table, window: int) -> pa.Table:
    """Byte ranges of one bucket that are covered by windows which start anywhere else, too."""
    found, marks, texts = [], [], []
    for p, z in zip(table.column("places").to_pylist(), table.column("texts").to_pylist()):
        if z is None:
            found.append(np.stack(unbundle(p, 4)))
        else:
            marks.append(np.stack(unbundle(p, 7)))
            texts.append(zstandard.decompress(z))
    if marks:
        k, t, key, at, lo, hi, twice = np.concatenate(marks, axis=1)
        data = np.frombuffer(b"".join(texts), np.uint8)
        room, size, left = padded(data), hi - lo, at - lo
        start = np.concatenate(([0], np.cumsum(size)[:-1]))
        # equal contexts: all their windows are repeated; one of them stays to meet the others
        look = np.fromiter((xxhash.xxh3_64_intdigest(data[s : s + n]) for s, n in zip(start, size)), np.uint64, len(start))
        order = np.lexsort((left, look, key))
        a, b = order[1:], order[:-1]
        same = (key[a] == key[b]) & (look[a] == look[b]) & (size[a] == size[b]) & (left[a] == left[b])
        same[same] = equal_spans(room, start[a[same]], start[b[same]], size[a[same]])
        many, extra = twice.astype(bool), np.zeros(len(k), bool)
        many[a[same]] = many[b[same]] = extra[a[same]] = True
        found.append(np.stack((k[many], t[many], lo[many], hi[many])))
        # the others, where a hash has different contexts
        rest = order[~extra[order]]
        groups, counts = np.unique(key[rest], return_counts=True)
        rest = rest[np.isin(key[rest], groups[counts > 1])]
        if len(rest) and not many[rest].all():
            n = len(rest)
            group = np.unique(key[rest], return_inverse=True)[1]
            right_size, left_size = size[rest] - left[rest], left[rest]
            anchor = start[rest] + left[rest]
            by_right, common_right = sort_suffixes(data, anchor, right_size, group)
            # left sides backwards
            back, offsets = gather(data, start[rest], anchor)
            back = np.ascontiguousarray(back[::-1])
            by_left, common_left = sort_suffixes(back, len(back) - offsets[1:], left_size, group)
            alone = ~many[rest]
            hits = []
            for o in range(int(left_size.max()) + 1):
                valid = (left_size >= o) & (right_size >= window - o)
                if not valid.any():
                    continue
                lc, rc = np.empty(n, np.int64), np.empty(n, np.int64)
                lc[by_left] = np.cumsum(common_left < o)
                rc[by_right] = np.cumsum(common_right < window - o)
                own = np.flatnonzero(valid)
                pair = lc[own] * (n + 1) + rc[own]
                by = np.argsort(pair)
                equal = pair[by][1:] == pair[by][:-1]
                hit = np.zeros(len(own), bool)
                hit[by[1:][equal]] = hit[by[:-1][equal]] = True
                own = own[hit]
                own = own[alone[own]]
                hits.append(np.stack((own, np.full(len(own), o))))
            who, o = np.concatenate(hits, axis=1) if hits else np.zeros((2, 0), np.int64)
            by = np.lexsort((o, who))
            who, o = who[by], o[by]
            cut = np.flatnonzero((np.diff(who) != 0) | (np.diff(o) != 1))
            first, last = np.append(0, cut + 1)[: len(who)], np.append(cut, len(who) - 1)[: max(len(who), 0)]
            if len(who):
                x = rest[who[first]]
                found.append(np.stack((k[x], t[x], at[x] - o[last], at[x] - o[first] + window)))
    cols = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
    return pa.table([pa.array(c) for c in cols], names=["k", "t", "lo", "hi"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.binary())
    for batch in batches:
        rows, held = [], 0
        for i, z, spans in zip(batch.column("id"), batch.column("z"), batch.column("spans")):
            text, cut = zstandard.decompress(z.as_py()), []
            for lo, hi in sorted((x["lo"], x["hi"]) for x in spans.as_py() or ()):
                if cut and lo <= cut[-1]["hi"]:
                    cut[-1]["hi"] = max(cut[-1]["hi"], hi)
                else:
                    cut.append({"lo": lo, "hi": hi})
            edges = [0, *(e for c in cut for e in (c["lo"], c["hi"])), len(text)]
            rows.append((i.as_py(), len(text), cut, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))))
            held += len(text)
            if held > 4 * MAP_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["id", "n_bytes", "spans", "kept"])
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], ["id", "n_bytes", "spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (maximal removed ranges) and kept (the bytes left).

    Texts are UTF-8; null is empty. A byte goes if a window of ``window`` bytes that covers it also starts anywhere else, in
    another document or in the same one; overlapping windows count, and every copy goes. Shorter texts stay. Rows that
    repeat identifier and text are one document and get the same result, so they are no copies of each other; equal
    texts under different identifiers are. A null identifier is one of its own. Other columns are ignored.
    """
    read = keyed(docs, id_col, text_col)
    # a row that is repeated as a whole is one document
    texts = read.select("k", "t", "text")
    counted = texts.select("text").mapInArrow(lambda b: _count_cells(b, gram), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    whole = counted.where("cell IS NULL").first()
    places = whole["n"] if whole else 0
    hot = np.array([r[0] for r in counted.where(F.col("cell").isNotNull() & (F.col("n") * HOT_SHARE > places)).select("cell").collect()], np.int64)

    anchors = settled(texts.mapInArrow(lambda b: _anchors(b, window, gram, hot), "k long, t long, key long, at long, lo long, hi long"), "anchors")
    anchored = anchors.where("key IS NOT NULL")
    counts = settled(anchored.groupBy("key").count().where("count > 1"), "repeated-keys")
    # keys with more than one anchor in HOT_KEYS are known to repeat, and stay out of the join that finds the others
    total = counts.agg(F.sum("count")).first()[0] or 0
    known = [r["key"] for r in counts.where(F.col("count") * HOT_KEYS > total).select("key").collect()]
    hot_key = F.col("key").isin(known) if known else F.lit(False)
    repeated = anchored.where(~hot_key).join(counts.where(~hot_key).select("key"), "key", "left_semi")
    repeated = repeated.unionByName(anchored.where(hot_key))
    # repeated rows give every anchor twice; they are one document
    again = repeated.groupBy("k", "t").agg(F.collect_set(F.struct("key", "at", "lo", "hi")).alias("anchors"))
    packed = squeezed(read)
    cut = packed.select("k", "t", "z").join(again, ["k", "t"])
    # about a quarter of this is sent: contexts cover every place two or three times, but few repeat
    buckets = max(1, -(-places // bucket_bytes))
    sent = cut.dropDuplicates(["k", "t"]).mapInArrow(lambda b: _contexts(b, buckets), "bucket long, places binary, texts binary")
    spans = sent.groupBy("bucket").applyInArrow(lambda group: _repeats(group, window), "k long, t long, lo long, hi long")
    spans = spans.union(anchors.where("key IS NULL").select("k", "t", "lo", "hi"))
    by_doc = spans.groupBy("k", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = packed.join(by_doc, ["k", "t"], "left").select("id", "z", "spans")
    out = joined.mapInArrow(_cut, "id long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")
    return out.select(F.col("id").alias(id_col), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), "spans", "kept")
