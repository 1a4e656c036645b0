"""The filter audit against a run of every order over every document."""

import math
import re
from itertools import permutations

from freshet.llm.filter_audit import audit_filters

DOCS = "doc_id long, text string, source string, part string, mask string, n string, id string, digest string, good string, tally string"
LABELS = "doc_id long, quality int, toxic int, part string, id string"


def plain(docs, labels):
    label = {}
    for i, q, t in labels:
        if i is not None:
            a, b = label.get(i, (0, 0))
            label[i] = (a | (q == 1), b | (t == 1))
    seen = {}
    for i, text, _ in docs:
        seen.setdefault(text or "", []).append(i)
    rows = []
    for i, text, source in docs:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", x)) > 5 * len(x)) + "D" * bool(re.search(r"[#$%&*|]", x))
        if any(j is not None and (i is None or j < i) for j in seen[x]):
            fails += "E"
        rows.append((source or "", fails, *label.get(i, (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == f for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "p", "m", "n", "i", "d", "g", "t") for r in docs], DOCS)
    x = spark.createDataFrame([(*r, "p", "i") for r in labels], LABELS)
    return audit_filters(d, x).collect()


def test_every_order(spark, odd_texts):
    loud = "CAPS AND # " * 40
    docs = [(i, x, (None, "", "a", "b")[i % 4]) for i, x in enumerate(odd_texts)]
    docs += [(100 + i, loud, "a") for i in range(4)] + [(102, loud, "b"), (102, loud, "b"), (None, loud, "a"), (None, loud, None), (None, "only here", "c"), (None, "only here", "c")]
    labels = [(0, 1, 0), (9, 1, 1), (101, 1, None), (101, None, 1), (102, 0, 1), (None, 1, 1), (103, 1, 1), (100, None, None), (999, 1, 1)]
    got = audited(spark, docs, labels)
    want = plain(docs, labels)
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in counts] for r in got} == want
    for r in got:
        # the definition of the value by potentials
        assert math.isclose(r["potential"] - r["potential_without"], r["shapley"] / 120, abs_tol=1e-9)


def test_no_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    (row,) = {tuple(r[c] for c in ("kept", "removed", "good_lost", "shapley") if r["filter_order"] == "ABCDE" and r["step"] == 1) for r in audited(spark, [(None, None, None)], [])} - {()}
    assert row == (0, 1, 0, 120)
