"""The prefix trie against a plain one, and list ranking against a walk."""

import hashlib
import random
import zlib

import pytest

from freshet.llm.list_ranking import rank_list
from freshet.llm.prefix_trie import conversation_trie, marked_turns, prefix_trie, rebuilt

TURNS = "conv_id long, turn long, role string, text string, depth string, num string, mark string, size string, bucket string, base string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        # ties in turn: by the operator's own digest
        convs[c].sort(key=lambda r: (r[0], r[1], hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = [r[2:] for r in convs.get(c - c % 5, [])[:h] + own[h:]]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        found, todo = [], [p]
        while todo:
            q = todo.pop()
            found.append(q)
            todo += kids.get(q, [])
        return found

    out = []
    for p, m in members.items():
        sub = below(p)
        ends = ",".join(str(c) for c in sorted(c for c in m if len(whole[c]) == len(p)))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), sum(not kids.get(q) for q in sub),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in sub if q), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: r[:2])


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "n", "m", "s", "b", "x") for r in rows], TURNS)


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), 10**12 + 3, 10**12 + 1]:
        if rng.random() < 0.15:
            continue
        for t in range(rng.choice([1, 2, 3, 8, 9, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "né", "", f"turn {rng.randrange(4)}"])))
    # same conversations under many identifiers, a long one, nulls, ties, repeated rows
    rows += [(c, t, "user", f"common {t}") for c in range(100, 140) for t in range(4)]
    rows += [(205, t, None, None if t % 3 else "x") for t in range(150)] + [(206, t, "user", "y") for t in range(120)]
    rows += [(61, None, "user", "first"), (61, None, "user", "first"), (61, 5, "user", "b"), (61, 5, "user", "a"), (61, 5, None, "a"), (61, 5, "user", "b")]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (70, 3, "user", "ab"), (70, 4, "usera", "b"), (71, 3, "usera", "b"), (71, 4, "user", "ab")]
    rng.shuffle(rows)
    return rows


def test_trie(spark, talk):
    want = plain(talk)
    assert collected(conversation_trie(frame(spark, talk))) == want
    # hot conversations cut into blocks, and the tour over many tasks and rounds
    convs, turns = rebuilt(marked_turns(frame(spark, talk)), rows_per_block=7)
    assert collected(prefix_trie(convs, turns, rows_per_block=7, per_task=20)) == want


def test_small_tries(spark):
    assert collected(conversation_trie(frame(spark, []))) == []
    assert collected(conversation_trie(frame(spark, [(None, 1, "user", "a")]))) == []
    for rows in ([(7, 0, "user", "é")], [(6, i, "user", "a") for i in range(2)] + [(8, 0, None, None)], [(0, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")]):
        assert collected(conversation_trie(frame(spark, rows))) == plain(rows)
    # a conversation whose turns are all replaced by an absent one's has none, and is a member of the root only
    c = next(i for i in range(1, 100) if i % 5 and zlib.crc32(str(i).encode()) % 9 > 2)
    rows = [(c, 0, "u", "a"), (c, 1, "u", "b")]
    assert collected(conversation_trie(frame(spark, rows))) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def walked(lists, weight):
    out = {}
    for order in lists:
        total = 0
        for at, x in enumerate(order):
            out[x] = (order[0], at, total)
            total += weight[x]
    return out


@pytest.mark.parametrize("n, per_task", [(1, 10), (500, 1000), (500, 40), (3000, 100)])
@pytest.mark.parametrize("shuffled", [False, True])
def test_ranks(spark, n, per_task, shuffled):
    rng = random.Random(n)
    order = [i * 3 for i in range(n)]
    if shuffled:
        rng.shuffle(order)
    lists = [order[: n // 3], order[n // 3 :]] if n > 1 else [order]
    weight = {x: rng.randrange(-5, 50) for x in order}
    rows = [(x, y, weight[x]) for one in lists for x, y in zip(one, [*one[1:], None])]
    rng.shuffle(rows)
    got = rank_list(spark.createDataFrame(rows, "el long, next long, w long"), ["w"], per_task=per_task, least=100)
    assert {r["el"]: (r["list"], r["rank"], r["w"]) for r in got.collect()} == walked(lists, weight)


def test_no_lists(spark):
    kind = "el long, next long, w long"
    assert rank_list(spark.createDataFrame([], kind), ["w"]).collect() == []
    for rows in ([(1, 2, 0), (2, 1, 0)], [(1, 1, 0)], [(1, 3, 0), (2, 3, 0), (3, None, 0)], [(1, None, 0), (1, 2, 0), (2, None, 0)]):
        with pytest.raises(Exception):
            rank_list(spark.createDataFrame(rows, kind), ["w"]).collect()
