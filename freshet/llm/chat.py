"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant turns in alternation, ending with the assistant.
Every input turn may keep its role, take another one, or be merged into the turn before it, and empty turns may be inserted
where a role is missing. Dynamic programming over the automaton of legal turns finds the cheapest repair, which is then rendered.

Turns are range-partitioned by conversation and position, so a long conversation lies in several partitions. A partition's
part of a conversation is a matrix of costs from state to state; these multiply (least sums), so only the parts at partition
edges, at most two per partition, have to meet before every partition can choose its own repairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.session import settled

ROLES = ("system", "user", "assistant")
# states: nothing yet, after a system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
LEGAL = {(START, "system"), (START, "user"), (SYSTEM, "user"), (USER, "assistant"), (ASSISTANT, "user")}
# costs of one change each
RELABEL, MERGE, INSERT = 3, 1, 2
NEVER = 10**9

HEAD, TAIL = "<|im_start|>{role}\n", "<|im_end|>\n"
JOINT = "\n\n"
# spellings of roles that are the same role
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}

Step = tuple[int, str, bool, tuple[str, ...]]  # state after, role, merged, roles inserted before


def canonical(role: str | None) -> str | None:
    """The role's own name, or None if it is none of ROLES."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return name if name in ROLES else None


def _insertions(state: int) -> list[tuple[int, tuple[str, ...]]]:
    """States that no, one or two inserted empty turns lead to, with the turns; a system turn is never inserted."""
    out, reached = [(state, ())], [(state, ())]
    for _ in range(2):
        reached = [(AFTER[r], (*done, r)) for at, done in reached for r in ("user", "assistant") if (at, r) in LEGAL]
        out += reached
    return out


def _options() -> dict[tuple[int, str | None], list[tuple[int, Step]]]:
    """For a state and a role given, the cheapest step to every next state; ties go to the step listed first."""
    table = {}
    for state in range(4):
        for given in (*ROLES, None):
            best: dict[int, tuple[int, Step]] = {}

            def offer(cost: int, step: Step, best: dict = best) -> None:
                if step[0] not in best or cost < best[step[0]][0]:
                    best[step[0]] = (cost, step)

            # an unknown role has to be named, which costs as much as another name
            for role in sorted(ROLES, key=lambda r: r != given):
                change = 0 if role == given else RELABEL
                if AFTER[role] == state:
                    offer(change + MERGE, (state, role, True, ()))
                for at, inserted in _insertions(state):
                    if (at, role) in LEGAL:
                        offer(change + INSERT * len(inserted), (AFTER[role], role, False, inserted))
            table[state, given] = [best[s] for s in sorted(best)]
    return {k: [(c, s) for c, s in v] for k, v in table.items()}


OPTIONS = _options()
# what a conversation still needs at its end
ENDING = {START: (), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def forward(costs: list[int], roles: list[str | None]) -> tuple[list[int], list[list[tuple[int, Step] | None]]]:
    """Least costs by state after the turns, from costs by state before them, and the way back for every turn."""
    ways: list[list[tuple[int, Step] | None]] = []
    for role in roles:
        after, back = [NEVER] * 4, [None] * 4
        for state in range(4):
            if costs[state] < NEVER:
                for cost, step in OPTIONS[state, role]:
                    if costs[state] + cost < after[step[0]]:
                        after[step[0]], back[step[0]] = costs[state] + cost, (state, step)
        costs = after
        ways.append(back)
    return costs, ways


def backward(ways: list[list[tuple[int, Step] | None]], end: int) -> tuple[list[Step], int]:
    """The steps that lead to state ``end``, and the state they start from."""
    steps, state = [], end
    for back in reversed(ways):
        state, step = back[state]
        steps.append(step)
    return steps[::-1], state


def matrix(roles: list[str | None]) -> list[list[int]]:
    """Least cost from every state before the turns to every state after them."""
    return [forward([0 if s == start else NEVER for s in range(4)], roles)[0] for start in range(4)]


def final(costs: list[int]) -> tuple[int, int]:
    """Least total cost with the ending, and the state before it."""
    return min((costs[s] + INSERT * len(ENDING[s]), s) for s in range(4))


def repaired(roles: list[str | None]) -> tuple[int, list[Step], tuple[str, ...]]:
    """The cheapest repair of a whole conversation: cost, steps, and the turns inserted at the end."""
    costs, ways = forward([0, NEVER, NEVER, NEVER], roles)
    cost, end = final(costs)
    return cost, backward(ways, end)[0], ENDING[end]


def _empty(roles: tuple[str, ...]) -> str:
    return "".join(HEAD.format(role=r) + TAIL for r in roles)


FRESH = [0, NEVER, NEVER, NEVER]
EDGE = pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv", pa.int64()), ("n", pa.int64()), ("values", pa.list_(pa.int64()))])
OUT = pa.schema(
    [("conv", pa.int64()), ("turn", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("action", pa.string()),
     ("inserted", pa.list_(pa.string())), ("rendered", pa.string()), ("cost", pa.int64())]
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.string()): "array<string>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def _conversations(part: pa.Table) -> list[tuple[int, int | None, pa.Table]]:
    """The conversations of a partition in order: place (0 the first, 1 the last, 2 both, -1 between), id and turns."""
    part = part.sort_by("seq")
    ids = part.column("conv").to_pylist()
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    last = len(cuts) - 2
    return [(2 if last == 0 else 0 if i == 0 else 1 if i == last else -1, ids[cuts[i]], part.slice(cuts[i], cuts[i + 1] - cuts[i])) for i in range(last + 1)]


def _roles(turns: pa.Table) -> list[str | None]:
    return [canonical(r) for r in turns.column("role").to_pylist()]


def _edge_rows(part: pa.Table, values) -> pa.Table:  # noqa: ANN001
    """A row for the first and the last conversation of a partition, with what ``values`` makes of place and roles."""
    no = part.column("part")[0].as_py()
    rows = [(no, place, conv, len(turns), values(no, place, _roles(turns))) for place, conv, turns in _conversations(part) if place >= 0]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), EDGE)], schema=EDGE)


def _spans(edges: list) -> list[list]:
    """Edge rows of conversations that lie in more than one partition, in order."""
    rows, out = sorted(edges, key=lambda r: (r["part"], r["place"])), []
    for r in rows:
        if out and out[-1][-1]["conv"] == r["conv"]:
            out[-1].append(r)
        else:
            out.append([r])
    return [x for x in out if len(x) > 1]


def _enter(edges: list) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Costs by state before, and turns before, for every part of a split conversation, from the parts' matrices."""
    out = {}
    for span in _spans(edges):
        costs, n = np.array(FRESH), 0
        for r in span:
            out[r["part"], r["place"]] = (costs.tolist(), n)
            costs, n = np.minimum((costs[:, None] + np.array(r["values"]).reshape(4, 4)).min(axis=0), NEVER), n + r["n"]
    return out


def _leave(edges: list) -> dict[tuple[int, int], tuple[int, int, bool]]:
    """The state to end in, the total cost and whether the conversation ends, for every part of a split conversation. Rows give the costs
    after the part and, for every state after it, the state before it."""
    out = {}
    for span in _spans(edges):
        total, end = final(span[-1]["values"][:4])
        for i, r in reversed(list(enumerate(span))):
            out[r["part"], r["place"]] = (end, total, i == len(span) - 1)
            end = r["values"][4 + end]
    return out


def _render(part: pa.Table, enter: dict, leave: dict) -> pa.Table:
    no = part.column("part")[0].as_py()
    rows: list[tuple] = []
    for place, conv, turns in _conversations(part):
        before, at = enter.get((no, place), (FRESH, 0))
        costs, ways = forward(before, _roles(turns))
        cost, end = final(costs)
        ends = True
        if (no, place) in leave:
            end, cost, ends = leave[no, place]
        steps, state = backward(ways, end)
        given = turns.column("role").to_pylist()
        for i, (step, turn, text) in enumerate(zip(steps, turns.column("turn").to_pylist(), turns.column("text").to_pylist())):
            state_after, role, merged, inserted = step
            if merged:
                piece = JOINT + text
            else:
                piece = ("" if state == START else TAIL) + _empty(inserted) + HEAD.format(role=role) + text
            if ends and i == len(steps) - 1:
                piece += TAIL + _empty(ENDING[end])
            action = "+".join([*(["relabel"] if canonical(given[i]) != role else []), *(["merge"] if merged else [])]) or "keep"
            rows.append((conv, turn, at + i, role, action, list(inserted), piece, cost))
            state = state_after
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


def format_chats(chats: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, turn, at (position in the conversation from 0), role (as repaired), action (keep, relabel, merge or
    relabel+merge), inserted (empty turns before it), rendered (the turn's share of the rendering) and cost (of the whole conversation).
    A conversation's rendering is its ``rendered`` pieces in order of ``at``.

    Roles are read without case and surrounding space; an unknown or null one has to be relabelled. A null text is empty. Turns are
    ordered by turn (null last), role and text, so ties and repeated rows have one order; every row stays a turn. Turns with a null
    conversation are one conversation. An empty table gives an empty one. Other columns are ignored.
    """
    read = chats.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    # splitters travel through the driver: of a text only its hash takes part
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.xxhash64("text")]
    dealt = read.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    # written once, so that all passes see the same partitions whatever happens to an executor
    held = settled(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "turns")
    light = held.select("part", "seq", "conv", "role").groupBy("part")

    matrices = light.applyInArrow(lambda part: _edge_rows(part, lambda no, place, roles: sum(matrix(roles), [])), _ddl(EDGE)).collect()
    enter = _enter(matrices)
    leave: dict = {}
    if enter:

        def ways_back(no: int, place: int, roles: list[str | None]) -> list[int]:
            costs, ways = forward(enter.get((no, place), (FRESH, 0))[0], roles)
            return [*costs, *(backward(ways, end)[1] if costs[end] < NEVER else -1 for end in range(4))]

        leave = _leave(light.applyInArrow(lambda part: _edge_rows(part, ways_back), _ddl(EDGE)).collect())
    out = held.groupBy("part").applyInArrow(lambda part: _render(part, enter, leave), _ddl(OUT))
    return out.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
