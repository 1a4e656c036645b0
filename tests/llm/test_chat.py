"""Role repair against a search over all repairs, and split conversations against whole ones."""

import itertools
import random

import pytest

from freshet.llm import chat
from freshet.llm.chat import ENDING, INSERT, LEGAL, MERGE, NEVER, RELABEL, START, canonical, format_chats, repaired

SCHEMA = "conv_id long, turn long, role string, text string, part string"


def plain_cost(roles):
    """Cheapest repair by trying every role, merge and insertion for every turn."""
    names = ("system", "user", "assistant")
    best = {START: 0}
    for given in roles:
        after = {}
        for state, cost in best.items():
            for role in names:
                change = 0 if role == given else RELABEL
                if chat.AFTER[role] == state:
                    after[state] = min(after.get(state, NEVER), cost + change + MERGE)
                for n in range(4):
                    for inserted in itertools.product(("user", "assistant"), repeat=n):
                        at, good = state, True
                        for r in (*inserted, role):
                            good, at = good and (at, r) in LEGAL, chat.AFTER[r]
                        if good:
                            after[at] = min(after.get(at, NEVER), cost + change + INSERT * n)
        best = after
    return min(c + INSERT * len(ENDING[s]) for s, c in best.items())


def rendered_roles(text):
    return [line.removeprefix("<|im_start|>") for line in text.split("\n") if line.startswith("<|im_start|>")]


def legal(roles):
    body = roles[1:] if roles[:1] == ["system"] else roles
    return len(body) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


@pytest.mark.parametrize("seed", range(3))
def test_cost_is_least(seed):
    rng = random.Random(seed)
    for _ in range(200):
        roles = [rng.choice(["system", "user", "assistant", None]) for _ in range(rng.randint(0, 6))]
        assert repaired(roles)[0] == (plain_cost(roles) if roles else 0)


def rows_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["at"]):
        out.setdefault(r["conv_id"], []).append(r)
    return out


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", "a", "x"), (1, 1, "user", None, "x"), (1, 1, "user", None, "x"), (2, 0, None, "", "x"), (3, None, "Assistant ", "hi", "x"),
        (None, 0, "human", "q", "x"), (None, 1, "bot", "r" * 100_000, "x"), (4, 5, "system", "s", "x"),
    ]
    got = rows_of(format_chats(spark.createDataFrame(rows, SCHEMA)))
    assert {k: len(v) for k, v in got.items()} == {1: 3, 2: 1, 3: 1, None: 2, 4: 1}
    for turns in got.values():
        assert legal(rendered_roles("".join(r["rendered"] for r in turns)))
    assert [r["action"] for r in got[1]] == ["keep", "merge", "merge"]
    assert got[3][0]["inserted"] == ["user"] and got[None][1]["cost"] == 0
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_split_conversation(spark):
    rng = random.Random(5)
    roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(3000)]
    rows = [(7, i, r, f"t{i}", "x") for i, r in enumerate(roles)] + [(8, 0, "user", "q", "x"), (8, 1, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(format_chats(df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    cost, steps, ending = repaired([canonical(r) for r in roles])
    assert [r["at"] for r in got[7]] == list(range(3000))
    assert {r["cost"] for r in got[7]} == {cost}
    assert [(r["role"], "merge" in r["action"]) for r in got[7]] == [(s[1], s[2]) for s in steps]
    text = "".join(r["rendered"] for r in got[7])
    assert legal(rendered_roles(text)) and text.count("<|im_end|>") == text.count("<|im_start|>")
