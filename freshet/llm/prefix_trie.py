"""The trie of conversation prefixes, by an Euler tour.

Conversations that begin with the same turns share nodes. A node is named by its smallest member and its depth, which is exact; which
conversations share it is told by running sums of 128-bit hashes of (turn, position). Every node has an enter and an exit arc; the tour
goes from enter to the first child or the own exit, and from exit to the next sibling's enter or the parent's exit. The tour is ranked as a linked list
over the cluster with the prefix sums of its leaves and savings, and a subtree's total is the difference of the sums at its two arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from freshet.llm.list_ranking import PER_TASK, rank_list
from freshet.operators.ordered import ROWS_PER_BLOCK, row_numbers, split
from freshet.session import settled

FAMILY, HEADS = 5, 9
# conversations of one bucket of siblings, and turns of one conversation that are joined in one group
BUCKET_BITS, TURN_BITS = 12, 16
# identifiers in one piece of a list that is hashed
PIECE_IDS = 1 << 16
LANES = ["s1", "s2", "s3", "s4"]
OWN = ["x1", "x2", "x3", "x4"]


def marked_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, mark (digest of role and text) and size (bytes of the text); without turns of no conversation."""
    r, x = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, x)))
    return turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), mark.alias("mark"), F.octet_length(x).cast("long").alias("size"))


def numbered(convs: DataFrame) -> DataFrame:
    """Adds num, the place of each distinct ``conv`` in ascending order from 0 on; ranges are counted, so no task sees all."""
    placed = settled(convs.repartitionByRange("conv").sortWithinPartitions("conv").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    # one row per range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_part", part).join(ranges, "_part").withColumn("num", F.col("_before") + at).drop("_at", "_part", "_before")


def _salted(convs: DataFrame) -> DataFrame:
    """A row per 2 ** TURN_BITS turns of a conversation, so that no group of a join has more."""
    return convs.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n"), TURN_BITS))))


def rebuilt(marked: DataFrame, family: int = FAMILY, heads: int = HEADS, rows_per_block: int | None = ROWS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of their family's first one, and their turns.

    A conversation c takes the first h turns of conversation c - c % ``family`` (all if it has fewer, none if it is absent), then its own after its
    first h, with h = crc32(decimal c) % ``heads``. Turns are ordered by turn, null first; ties by a digest of role and text. Returns
    (conv, num, length) and (conv, num, depth, mark, size, last).
    """
    marked = settled(marked, "marked")
    placed = row_numbers(marked, ["conv"], ["turn", "mark"], "at", rows_per_block)
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = numbered(marked.groupBy("conv").agg(F.count(F.lit(1)).alias("n")))
    convs = convs.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % family)
    bases = convs.where(F.col("conv") % family == 0).select(F.col("conv").alias("base"), F.col("n").alias("_base_n"))
    taken = F.least("h", F.coalesce("_base_n", F.lit(0)))
    # at most ``family`` conversations to a base
    convs = convs.join(bases, "base", "left").withColumn("taken", taken)
    convs = settled(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")

    first = placed.where((F.col("conv") % family == 0) & (F.col("at") < heads)).select(F.col("conv").alias("base"), F.col("at").alias("depth"), "mark", "size")
    shared = convs.join(first, "base").where("depth <= taken")
    rest = placed.withColumn("_salt", F.shiftright("at", TURN_BITS)).join(_salted(convs.select("conv", "num", "n", "h", "taken", "length")), ["conv", "_salt"])
    rest = rest.where("at > h").withColumn("depth", F.col("at") - F.col("h") + F.col("taken"))
    columns = ["conv", "num", "depth", "mark", "size", (F.col("depth") == F.col("length")).alias("last")]
    return convs.select("conv", "num", "length"), settled(shared.select(*columns).union(rest.select(*columns)), "rebuilt")


def _prefixes(turns: DataFrame, rows_per_block: int | None) -> DataFrame:
    """Adds the four lanes of each turn's own hash, and their running sums over the conversation."""
    a, b = F.xxhash64("mark", "depth"), F.xxhash64(F.lit(7), "mark", "depth")
    lane = F.lit((1 << 32) - 1)
    own = [F.shiftrightunsigned(a, 32), a.bitwiseAND(lane), F.shiftrightunsigned(b, 32), b.bitwiseAND(lane)]
    blocks = split(turns.withColumns(dict(zip(OWN, own))), ["num"], ["depth"], rows_per_block)
    rows = blocks.df.withColumns({s: F.sum(x).over(blocks.window()) for s, x in zip(LANES, OWN)})
    if blocks.is_split:
        sums = blocks.summary(*[F.sum(x).alias(f"_{s}") for s, x in zip(LANES, OWN)])
        sums = sums.withColumns({f"_{s}": F.sum(f"_{s}").over(blocks.before()) for s in LANES})
        rows = blocks.attach(rows, sums).withColumns({s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in LANES})
    return blocks.plain(rows).select("conv", "num", "depth", "size", "last", *OWN, *LANES)


KEY = ["depth", *LANES]
PARENT = ["pd", "p1", "p2", "p3", "p4"]


def _nodes(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    found = prefixes.groupBy(*KEY).agg(
        F.min("num").alias("num"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
        *[F.max(F.col(s) - F.col(x)).alias(p) for s, x, p in zip(LANES, OWN, PARENT[1:])],
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("num").alias("num"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in KEY], "num", "conv", "n_convs", zero.alias("size"), *[F.lit(None).cast("long").alias(p) for p in PARENT[1:]])
    return found.unionByName(root).withColumn("pd", F.when(F.col("depth") > 0, F.col("depth") - 1))


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children, first_child, next_sibling, parent_num and parent_conv; siblings are in the order of their smallest members.

    Siblings are linked within buckets of conversation numbers and these with each other, so the children of a node that a third of
    all conversations go through are no single group.
    """
    bucketed = nodes.withColumn("bucket", F.shiftright("num", BUCKET_BITS))
    summary = bucketed.where("depth > 0").groupBy(*PARENT, "bucket").agg(F.min("num").alias("_first"), F.count(F.lit(1)).alias("_n"))
    summary = settled(summary, "siblings")
    # a row per bucket: for 2 ** 12 conversations at most one
    across = Window.partitionBy(*PARENT).orderBy("bucket")
    parents = nodes.select(*[F.col(k).alias(p) for k, p in zip(KEY, PARENT)], F.col("num").alias("parent_num"), F.col("conv").alias("parent_conv"))
    buckets = summary.withColumn("_next", F.lead("_first").over(across)).join(parents, PARENT).select(*PARENT, "bucket", "_next", "parent_num", "parent_conv")
    children = summary.groupBy(*PARENT).agg(F.min("_first").alias("first_child"), F.sum("_n").alias("n_children"))
    children = children.select(*[F.col(p).alias(k) for k, p in zip(KEY, PARENT)], "first_child", "n_children")
    within = Window.partitionBy(*PARENT, "bucket").orderBy("num")
    rows = bucketed.join(children, KEY, "left").withColumn("_lead", F.lead("num").over(within)).join(buckets, [*PARENT, "bucket"], "left")
    return rows.select(
        *KEY, "num", "conv", "n_convs", "size", F.coalesce("n_children", F.lit(0)).alias("n_children"), "first_child",
        F.when(F.col("depth") > 0, F.coalesce("_lead", "_next")).alias("next_sibling"), "parent_num", "parent_conv",
    )


def tour(linked: DataFrame, width: int) -> DataFrame:
    """el, next, leaf and saved of the enter (even) and exit (odd) arcs; nodes are numbered num * ``width`` + depth."""

    def arc(num: str, depth: Column, side: int) -> Column:
        return (F.col(num) * width + depth) * 2 + side

    d, zero = F.col("depth"), F.lit(0).cast("long")
    down = F.when(F.col("n_children") > 0, arc("first_child", d + 1, 0)).otherwise(arc("num", d, 1))
    on = F.coalesce(arc("next_sibling", d, 0), arc("parent_num", d - 1, 1))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")

    def row(el: Column, following: Column, *weights: Column) -> Column:
        return F.struct(el.alias("el"), following.alias("next"), *[w.alias(c) for w, c in zip(weights, ("leaf", "saved"))])

    both = F.array(row(arc("num", d, 0), down, leaf, saved), row(arc("num", d, 1), on, zero, zero))
    return linked.select(F.explode(both).alias("arc")).select("arc.*")


def _listed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of the members' lists, from rows in the order of key and member: key, first member, text."""
    last: tuple | None = None
    held: list[int] = []

    def piece() -> pa.RecordBatch:
        values = [*last, held[0], ",".join(map(str, held))]
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], [*names, "first", "ids"])

    for batch in batches:
        out = []
        for *key, member in zip(*(batch.column(c).to_pylist() for c in [*names, "conv"])):
            if held and (tuple(key) != last or len(held) == PIECE_IDS):
                out.append((*last, held[0], ",".join(map(str, held))))
                held = []
            last = tuple(key)
            held.append(member)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*names, "first", "ids"])
    if held:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The digest of every key's list, from its pieces in order; only the state of one hash is held."""
    last: tuple | None = None
    state = None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*names, "ids"])):
            if tuple(key) == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                out.append((*last, state.hexdigest()))
            last, state = tuple(key), hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*names, "ends_sha256"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*last, state.hexdigest())], [*names, "ends_sha256"])


def member_digests(members: DataFrame, key: list[str]) -> DataFrame:
    """key and ends_sha256 of the members (``conv``) of every key, ascending, in decimal, joined by commas.

    Members are packed in ranges of (key, member), so a key with a third of all is spread; what one task then hashes in order, as
    the digest has to be, is one row per 65,536 of them.
    """
    typed = ", ".join(f"{c} long" for c in key)
    order = [*key, "conv"]
    pieces = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _listed(b, key), f"{typed}, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(lambda b: _hashed(b, key), f"{typed}, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, rows_per_block: int | None = ROWS_PER_BLOCK, per_task: int = PER_TASK) -> DataFrame:
    """One row per node, the root included, from what ``rebuilt`` returns.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256,
    the digest of the members that end here. No conversations, no nodes.
    """
    prefixes = settled(_prefixes(turns, rows_per_block), "prefixes")
    nodes = settled(_nodes(convs, prefixes), "nodes")
    linked = settled(_linked(nodes), "linked")
    width = (linked.agg(F.max("depth")).first()[0] or 0) + 1
    ranks = rank_list(tour(linked, width), ["leaf", "saved"], per_task)
    # sums up to the exit less sums up to the enter arc
    sign = F.when(F.col("el") % 2 == 1, 1).otherwise(-1)
    below = ranks.groupBy(F.shiftright("el", 1).alias("_node")).agg(F.sum(sign * F.col("leaf")).alias("n_leaves"), F.sum(sign * F.col("saved")).alias("saved_tokens"))
    zero = F.lit(0).cast("long")
    none = convs.where("length = 0").select(*[zero.alias(k) for k in KEY], "conv")
    ends = member_digests(settled(prefixes.where("last").select(*KEY, "conv").union(none), "ends"), KEY)
    rows = linked.withColumn("_node", F.col("num") * width + F.col("depth")).join(below, "_node").join(ends, KEY, "left")
    return rows.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of all conversations after ``rebuilt``; see ``prefix_trie``.

    A null role or text is empty; a null turn comes first, repeated ones are ordered by a digest of role and text, and repeated rows are turns of
    their own. Turns without a conversation are left out, other columns ignored. A conversation may be of any length, and a
    turn be shared by any number of them.
    """
    return prefix_trie(*rebuilt(marked_turns(turns, conv, turn, role, text)))
