"""Label carry and islands against plain loops over small random sequences, hot and cold."""

import random

import pytest

from freshet.operators import ordered
from freshet.operators.islands import carry_label, island_summary, islands, segments
from freshet.operators.ordered import row_numbers

HOT = 2  # rows per block: small enough to cut every longer key into many blocks


def sequences(seed, keys, longest):
    rng = random.Random(seed)
    rows = []
    for key in [None, *range(keys)]:
        for pos in range(rng.randint(1, longest)):
            label = f"L{key}-{pos}" if rng.random() < 0.15 else None
            rows.append((key, pos // 3, pos, label, rng.random() < 0.2))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, a int, b int, label string, stop boolean").repartition(3)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


def expected_carry(seq):
    """The rules by hand: carry forward until a stop, fall back to the next label."""
    result = []
    for i, (_, _, _, label, _) in enumerate(seq):
        carried, alive = None, False
        for _, _, _, lab, stop in seq[: i + 1][:-1]:
            if lab is not None:
                carried, alive = lab, True
            elif stop and carried is not None:
                alive = False
        if label is not None:
            carried, alive = label, True
        upcoming = next((s[3] for s in seq[i:] if s[3] is not None), None)
        result.append(carried if alive else upcoming)
    return result


@pytest.fixture(autouse=True)
def few_cuts(monkeypatch):
    monkeypatch.setattr(ordered, "MIN_CUTS", 2)


@pytest.mark.parametrize("rows_per_block", [None, HOT])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_carry_label_matches_a_loop(spark, seed, rows_per_block):
    rows = sequences(seed, 8, 40)
    got = carry_label(frame(spark, rows), ["k"], ["a", "b"], "label", "stop", rows_per_block=rows_per_block)
    assert set(got.columns) == {"k", "a", "b", "label", "stop", "eff_label"}
    found = {(r.k, r.b): r.eff_label for r in got.collect()}
    for key, seq in by_key(rows).items():
        assert [found[(key, r[2])] for r in seq] == expected_carry(seq), key
    assert len(found) == len(rows)


def test_cut_points_are_thinned(spark, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_CUTS", 5)
    rows = sequences(9, 3, 120)
    got = carry_label(frame(spark, rows), ["k"], ["a", "b"], "label", "stop", rows_per_block=HOT)
    found = {(r.k, r.b): r.eff_label for r in got.collect()}
    for key, seq in by_key(rows).items():
        assert [found[(key, r[2])] for r in seq] == expected_carry(seq)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_hot_keys_are_really_cut(spark, monkeypatch, limit):
    monkeypatch.setattr(ordered, "BROADCAST_BLOCKS", limit)
    rows = [(1, 0, i, None, False) for i in range(400)] + [(2, 0, 0, None, False)]
    b = ordered.split(frame(spark, rows), ["k"], ["a", "b"], rows_per_block=10)
    assert b.is_split
    sizes = {(r.k, r["_block"]): r["count"] for r in b.df.groupBy("k", "_block").count().collect()}
    assert len(sizes) > 10 and max(sizes.values()) < 120 and sizes[(2, 0)] == 1
    ranges = b.df.where("k = 1").groupBy("_block").agg({"b": "min"}).orderBy("_block").collect()
    assert [r["min(b)"] for r in ranges] == sorted(r["min(b)"] for r in ranges)


@pytest.mark.parametrize("rows_per_block", [None, HOT])
def test_islands_and_row_numbers_match_a_loop(spark, rows_per_block):
    rng = random.Random(5)
    rows = [(k, p // 4, p, rng.choice([None, "x", "y"]), False) for k in range(6) for p in range(rng.randint(1, 40))]
    df = frame(spark, rows)
    ids = {(r.k, r.b): r.island_id for r in islands(df, ["k"], ["a", "b"], "label", rows_per_block=rows_per_block).collect()}
    rn = {(r.k, r.b): r.rn for r in row_numbers(df, ["k"], ["a", "b"], rows_per_block=rows_per_block).collect()}
    for key, seq in by_key(rows).items():
        want, island = [], 0
        for i, r in enumerate(seq):
            island += i == 0 or r[3] != seq[i - 1][3]
            want.append(island)
        assert [ids[(key, r[2])] for r in seq] == want
        assert [rn[(key, r[2])] for r in seq] == list(range(1, len(seq) + 1))


@pytest.mark.parametrize("seed, broadcast", [(4, 0), (5, 10**6)])
def test_segments_are_the_same_hot_and_cold(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(ordered, "BROADCAST_BLOCKS", broadcast)
    rows = sequences(seed, 6, 40)
    cold, hot = ([tuple(r) for r in segments(frame(spark, rows), ["k"], ["a", "b"], "label", "stop", n).orderBy("k", "b").collect()] for n in (None, HOT))
    assert cold == hot
    carried = {(r[0], r[2]): r[5] for r in cold}
    totals = {(r[0], r[2]): (r[6], r[7]) for r in cold}
    for key, seq in by_key(rows).items():
        want, island = [], 0
        for i, r in enumerate(seq):
            island += i == 0 or carried[(key, r[2])] != carried[(key, seq[i - 1][2])]
            want.append(island)
        assert [totals[(key, r[2])] for r in seq] == [(w, island) for w in want]


def summarise(spark, steps):
    rows = [("p", 0, i, name if cloud else None, stop) for i, (name, cloud, stop) in enumerate(steps)]
    names = spark.createDataFrame([("p", i, name) for i, (name, _, _) in enumerate(steps)], "k string, b int, member string")
    df = spark.createDataFrame(rows, "k string, a int, b int, label string, stop boolean").join(names, ["k", "b"])
    found = segments(df, ["k"], ["b"], "label", "stop")
    summary = island_summary(found, ["k"], ["b"], "eff_label", "member", "stop", with_members=True)
    return [(r.label, r.members, r.last_flag, r.is_last) for r in summary.orderBy("island_id").collect()]


@pytest.mark.parametrize(
    "steps, want",
    [
        ([("m1", False, False)], [(None, ["m1"], False, True)]),
        ([("m1", True, True)], [("m1", ["m1"], True, True)]),
        ([("a", False, False), ("b", False, False), ("c", False, False)], [(None, ["a", "b", "c"], False, True)]),
        ([("s1", False, False), ("s2", True, False), ("s3", False, False)], [("s2", ["s1", "s2", "s3"], False, True)]),
        ([("a", True, True), ("b", True, False)], [("a", ["a"], True, False), ("b", ["b"], False, True)]),
        # a stop on a labelled row closes nothing by itself: the carrying goes on to the next label
        (
            [("m1", False, False), ("m2", True, True), ("m3", False, False), ("m4", True, False)],
            [("m2", ["m1", "m2", "m3"], False, False), ("m4", ["m4"], False, True)],
        ),
        # a stop on a label-less row does
        (
            [("m1", True, False), ("m2", False, True), ("m3", False, False), ("m4", True, False)],
            [("m1", ["m1", "m2"], True, False), ("m4", ["m3", "m4"], False, True)],
        ),
        (
            [("m1", True, False), ("m2", False, True), ("m3", False, False)],
            [("m1", ["m1", "m2"], True, False), (None, ["m3"], False, True)],
        ),
        # one label-less row alone has nothing to close
        ([("m1", False, True)], [(None, ["m1"], False, True)]),
    ],
)
def test_segments(spark, steps, want):
    assert summarise(spark, steps) == want
