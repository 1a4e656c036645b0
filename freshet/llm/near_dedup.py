"""Near-duplicate groups over word shingles by SetSketch.

Equal texts are one node from the start. Nodes that agree in all registers of a band are candidates. Within a band's
group every node is first compared with one hub; the links that hold join most groups into one component. What
is left, nodes of one group in different components, is compared in blocks by their registers, so that no task holds
a large group and no list of all pairs exists. Where more than a block is left outside a group's largest component, the group is
dealt anew by longer bands, in which fewer meet that are no links. Candidates pass by size and by the
joint likelihood of their registers; every link is then confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import LOWER, NO_ID, grams, hash_spans, mix, padded, raw, slices, words
from freshet.llm.components import components
from freshet.llm.packed import keyed, squeezed
from freshet.llm.setsketch import SetSketch, jaccard
from freshet.session import settled

SHINGLE = 5
SIMILARITY = 85  # per cent
ROWS = 5
# registers of a band, level by level: groups that are too large at one width are dealt anew at the next
WIDTHS = (ROWS, 2 * ROWS, 3 * ROWS)
PACKED_BYTES = 1 << 20
# bytes of text, and of registers, that are worked on at once; words and bands take many times as many bytes of memory
SLICE_BYTES, REGISTER_BYTES = 1 << 20, 1 << 19
MISSED = 4.5e-7  # at most this share of pairs at the threshold itself meets in no band
BLOCK = 256

@dataclass(frozen=True)
class Bound:
    """The similarity in per cent from which texts are linked, and what the candidates of that threshold need."""

    similarity: int

    def bands_of(self, width: int) -> int:
        """A pair at the threshold agrees in no band with probability (1 - similarity ** width) ** bands: at most ``MISSED``."""
        return 5 * math.ceil(math.log(MISSED) / math.log(1 - (self.similarity / 100) ** width) / 5)

    @property
    def bands(self) -> int:
        """25 bands of ROWS registers at 85, 40 at 80."""
        return self.bands_of(ROWS)

    def _below(self, errors: int) -> float:
        """So many standard errors of the registers below the threshold, rounded down to a twentieth."""
        share = self.similarity / 100
        return math.floor(20 * (share - errors * math.sqrt(share * (1 - share) / (self.bands * ROWS)))) / 20

    @property
    def estimate(self) -> float:
        """No link is estimated below this: 0.65 at 85, 0.60 at 80."""
        return self._below(6)

    @property
    def agreed(self) -> float:
        """No link agrees in a smaller share of its registers: 0.55 at 85, 0.50 at 80."""
        return self._below(9)


SKETCH = "id long, k long, t long, node binary, n long, registers binary"


def _shingles(part: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """Per row: a digest of its words, and the sorted hashes of its distinct shingles."""
    data, offsets = raw(part.column("text"))
    data = LOWER[data]
    ws, we, wo = words(data, offsets)
    room = padded(data)
    h = hash_spans(room, ws, we)
    g = grams(h, SHINGLE)
    for i in range(part.num_rows):
        a, b = wo[i], wo[i + 1]
        digest = hashlib.blake2b(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split()), digest_size=16).digest()
        if b - a >= SHINGLE:
            yield digest, np.unique(g[a : b - SHINGLE + 1])
        else:
            yield digest, mix(np.array([int.from_bytes(digest[:8], "little")], np.uint64)) if b > a else np.zeros(0, np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    sketch = SetSketch(bands * ROWS)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            nodes, sizes, registers = [], [], []
            for digest, s in _shingles(part):
                nodes.append(digest)
                sizes.append(len(s))
                registers.append(sketch.registers(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("k"), part.column("t"), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(registers, pa.binary())],
                ["id", "k", "t", "node", "n", "registers"],
            )


def _matrix(column: pa.Array, bands: int) -> np.ndarray:
    data, _ = raw(column)
    return data.view(np.uint16).reshape(len(column), bands * ROWS)


BANDED = "band long, number int, node binary"


def _bands(batches: Iterator[pa.RecordBatch], bands: int, width: int) -> Iterator[pa.RecordBatch]:
    """A row per node and band of ``width`` registers, keyed by these."""
    for batch in batches:
        for part in slices(batch, "registers", REGISTER_BYTES):
            values = raw(part.column("registers"))[0].view(np.uint16).reshape(part.num_rows, bands, width).astype(np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(width << 32), (part.num_rows, bands)).copy()
            for r in range(width):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, r])
            own = pa.array(np.repeat(np.arange(part.num_rows), bands))
            number = pa.array(np.tile(np.arange(bands, dtype=np.int32), part.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), number, part.column("node").take(own)], ["band", "number", "node"])


def _rebanded(batches: Iterator[pa.RecordBatch], bound: Bound, width: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Bands of ``width`` registers of packed texts, from hashes of their own."""
    bands = bound.bands_of(width)
    sketch = SetSketch(bands * width, seed)
    for batch in batches:
        for part in slices(batch, "z", PACKED_BYTES):
            registers = pa.array([sketch.registers(_set(z.as_py())).tobytes() for z in part.column("z")], pa.binary())
            yield from _bands(iter([pa.RecordBatch.from_arrays([part.column("node"), registers], ["node", "registers"])]), bands, width)


def _alike(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, bound: Bound) -> np.ndarray:
    """Whether pairs can be links, by size and by the likelihood of their registers."""
    good = 100 * np.minimum(na, nb) >= bound.similarity * np.maximum(na, nb)
    at = np.flatnonzero(good)
    if len(at):
        a, b = ra[at], rb[at]
        good[at] = jaccard((a > b).sum(1), (a < b).sum(1), (a == b).sum(1), na[at], nb[at]) >= bound.estimate
    return good


def _likely(batches: Iterator[pa.RecordBatch], bound: Bound) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            good = _alike(_matrix(batch.column("ra"), bound.bands), _matrix(batch.column("rb"), bound.bands), na, nb, bound)
            yield batch.select(["a", "b"]).filter(pa.array(good))


def _set(z: bytes) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a packed text."""
    part = pa.RecordBatch.from_arrays([pa.array([zstandard.decompress(z).decode()])], ["text"])
    return next(_shingles(part))[1]


def _linked(a: np.ndarray, b: np.ndarray, bound: Bound) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= bound.similarity * (len(a) + len(b) - both)


def _block(table: pa.Table, bound: Bound) -> pa.Table:
    """Links across two blocks of a group (or within one), of nodes in different components.

    A pair is compared in the first band that it shares, and confirmed here: only links leave the task.
    """
    side, number = table.column("side").to_numpy(), table.column("number")[0].as_py()
    node, n = table.column("node").combine_chunks(), table.column("n").to_numpy()
    root = np.unique([r.hex() for r in table.column("root").to_pylist()], return_inverse=True)[1]
    registers, texts = _matrix(table.column("registers").combine_chunks(), bound.bands), table.column("z")
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    within = not len(right)
    right = left if within else right
    sets: dict[int, np.ndarray] = {}
    found: list[tuple[int, int]] = []
    for at in range(0, len(left), 32):
        some = left[at : at + 32]
        equal = registers[some][:, None, :] == registers[right][None, :, :]
        # a pair is compared in the first band that it shares; groups of other bands than the registers' have number -1
        first = equal.reshape(len(some), len(right), bound.bands, ROWS).all(axis=3).argmax(axis=2) if number >= 0 else number
        # far fewer agreements than any estimate worth a look would have
        near = (equal.sum(axis=2) >= bound.agreed * bound.bands * ROWS) & (first == number) & (root[some][:, None] != root[right][None, :])
        x, y = np.nonzero(near)
        x, y = some[x], right[y]
        if within:
            x, y = x[x < y], y[x < y]
        good = _alike(registers[x], registers[y], n[x], n[y], bound)
        for i, j in zip(x[good].tolist(), y[good].tolist()):
            for k in (i, j):
                if k not in sets:
                    sets[k] = _set(texts[k].as_py())
            if _linked(sets[i], sets[j], bound):
                found.append((i, j))
    a, b = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table([node.take(pa.array(a)), node.take(pa.array(b))], names=["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch], bound: Bound) -> Iterator[pa.RecordBatch]:
    """The pairs whose full shingle sets are similar enough; pairs come sorted by a."""
    last: tuple[bytes | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        keep = []
        for za, zb in zip(batch.column("za"), batch.column("zb")):
            if (z := za.as_py()) != last[0]:
                last = (z, _set(z))
            keep.append(_linked(last[1], _set(zb.as_py()), bound))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Shingles are five words in lower case (A-Z), words being separated by white space; a shorter text is one shingle.
    Texts with a similarity of ``similarity`` per cent or more are linked; component_id is the smallest id reachable over links and
    kept says that it is the row's own. A text without words, or null, is linked with nothing. A null id comes after all
    others, and is its component's id only if no member has another. Rows that repeat an id share its result if their
    texts are equal, and are linked like any others if not. Other columns are ignored. ``with_key`` adds k and t, the key of
    ``doc_key``, and kept is then true for one key of a component, the least: of texts that share its id one stays.
    """
    bound = Bound(similarity)
    keys = keyed(docs, id_col, text_col)
    rows = settled(keys.mapInArrow(lambda part: _sketch(part, bound.bands), SKETCH), "sketches")
    classes = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("k", "t")).alias("d"), F.max("n").alias("n"), F.first("registers").alias("registers"))
    nodes = settled(classes.select("node", "d.k", "d.t", "n", "registers"), "nodes")
    texts = squeezed(keys)
    banded = nodes.select("node", "registers").mapInArrow(lambda part: _bands(part, bound.bands, ROWS), BANDED)
    roots = None
    for level, width in enumerate(WIDTHS):
        # groups of at least two, each with a hub; a group that many nodes share is one row here
        hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
        grouped = settled(banded.join(hubs, "band"), "band-groups")
        if level == 0:
            texts = _texts_of(grouped.select("node").distinct(), nodes, texts)
        roots, big = _linked_groups(grouped, nodes, texts, roots, bound, width == WIDTHS[-1], level == 0)
        if big is None:
            break
        # groups that are still too large fall apart in longer bands, drawn anew from the texts; later levels need no others
        wide, seed = WIDTHS[level + 1], level + 2
        texts = settled(texts.join(big, "node", "left_semi"), "texts")
        banded = texts.mapInArrow(lambda part, w=wide, s=seed: _rebanded(part, bound, w, s), BANDED)

    full = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = full.where("n > 0").groupBy("root").agg(F.min("k").alias("least"), *([F.min(F.struct("k", "t")).alias("least_key")] if with_key else []))
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("k"))
    out = full.join(least, "root", "left").withColumn("component_id", F.when(own != NO_ID, own))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    if with_key:
        kept = (F.col("n") == 0) | (F.struct("k", "t") == F.col("least_key"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *(["k", "t"] if with_key else []))


def _likely_pairs(pairs: DataFrame, nodes: DataFrame, bound: Bound) -> DataFrame:
    marks = nodes.select("node", "n", "registers")
    pa_, pb_ = (marks.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}")) for x in "ab")
    joined = pairs.join(pa_, "a").join(pb_, "b").select("a", "b", "na", "nb", "ra", "rb")
    return settled(joined.mapInArrow(lambda part: _likely(part, bound), "a binary, b binary"), "likely")


def _apart(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of groups with nodes in different components, with the group's size, its largest component (by a count over (group, component)) and how many are not in it."""
    placed = grouped.join(roots, "node", "left").select("band", "number", "node", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("m"))
    groups = shares.groupBy("band").agg(F.sum("m").alias("size"), F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    groups = groups.select("band", "size", F.col("most.root").alias("main"), (F.col("size") - F.col("most.m")).alias("rest"))
    return settled(placed.join(groups, "band"), "apart")


def _linked_groups(grouped: DataFrame, nodes: DataFrame, texts: DataFrame, roots: DataFrame | None, bound: Bound, last: bool, numbered: bool) -> tuple[DataFrame, DataFrame | None]:
    """Components (node, root) after the links within the groups of bands are added to those of ``roots``, and the nodes of groups that are too large to be compared at this width (none at the last one).

    Every node of a group is compared with a hub. What is then still apart is compared block by block, if the group's part
    outside its largest component fits a block.
    """
    pairs = grouped.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    if roots is not None:
        ends = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        for x, end in zip("ab", ends):
            pairs = pairs.join(end, x, "left").withColumn(f"root_{x}", F.coalesce(f"root_{x}", x))
        pairs = pairs.where("root_a != root_b").select("a", "b")
    links = settled(_confirmed(_likely_pairs(pairs, nodes, bound), texts, bound), "links")
    roots = components(links if roots is None else links.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    # nodes of one group that are still apart; those of groups of two have met already
    apart = _apart(grouped.where("size > 2").select("band", "number", "node"), roots)
    if not last:
        small = apart.where(F.col("rest") <= BLOCK)
        big = settled(apart.where(F.col("rest") > BLOCK).select("node").distinct(), "large-groups")
        big = None if big.isEmpty() else big
    else:
        small, big = apart, None
    if not small.isEmpty():
        more = settled(_compared(small, nodes, texts, bound, numbered), "more-links")
        if not more.isEmpty():
            roots = components(more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return roots, big


def _compared(apart: DataFrame, nodes: DataFrame, texts: DataFrame, bound: Bound, numbered: bool) -> DataFrame:
    """Links between nodes of one group in different components, block against block.

    Nodes of the largest component are not compared with each other, so each goes only to the blocks of the rest: where
    the rest fits one block, every node of the group is there once, and those of the rest once per block of the others.
    """
    minor = F.col("root") != F.col("main")
    p, q = F.ceil(F.col("rest") / BLOCK), F.ceil((F.col("size") - F.col("rest")) / BLOCK)
    hashed = F.xxhash64("node")
    own = F.when(minor, F.pmod(hashed, p)).otherwise(F.lit(-1) - F.pmod(hashed, q))
    zero = F.lit(0).cast("long")
    # blocks of the rest count from 0 up, those of the largest component from -1 down
    others = F.when(minor, F.concat(F.sequence(zero, p - 1), F.sequence(-q, F.lit(-1).cast("long")))).otherwise(F.sequence(zero, p - 1))
    dealt = apart.withColumn("own", own).withColumn("other", F.explode(others))
    number = F.col("number") if numbered else F.lit(-1)
    dealt = dealt.select(
        "band", number.alias("number"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root"
    )
    # registers and texts of a node are put together first, so that the blocks' rows meet both in one join
    wanted = nodes.select("node", "n", "registers").join(apart.select("node").distinct(), "node", "left_semi")
    held = settled(texts.join(wanted, "node"), "held")
    blocks = dealt.join(held, "node").groupBy("band", "i", "j")
    return blocks.applyInArrow(lambda group: _block(group, bound), "a binary, b binary").distinct()


def _texts_of(wanted: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, z: the packed text of every wanted node. Whole texts travel here only; all that follows reads these."""
    needed = nodes.select("node", "k", "t").join(wanted, "node", "left_semi")
    # rows that repeat id and text are one document: any of them will do
    return settled(texts.join(needed, ["k", "t"]).groupBy("node").agg(F.first("z").alias("z")), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame, bound: Bound) -> DataFrame:
    """Joins pairs to the texts of their nodes and keeps the links."""
    a, b = (texts.select(F.col("node").alias(x), F.col("z").alias(f"z{x}")) for x in "ab")
    joined = pairs.join(b, "b").join(a, "a").select("a", "b", "za", "zb").sortWithinPartitions("a")
    return joined.mapInArrow(lambda part: _confirm(part, bound), "a binary, b binary")
