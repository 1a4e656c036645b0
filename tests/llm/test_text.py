"""Operators on texts against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import components as components_of
from freshet.llm import near_dedup
from freshet.llm.bpe import encode_decode, load
from freshet.llm.decontaminate import find_contamination
from freshet.llm.exact_dedup import exact_groups
from freshet.llm.near_dedup import near_groups
from freshet.llm.queries import tokenizer_path
from freshet.llm.setsketch import SetSketch, jaccard, merged
from freshet.llm.substring_dedup import remove_repeats
from freshet.llm.suffix_dedup import remove_repeated_bytes, sort_suffixes

def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- op1 --------------------------------------------------------------------------------------


def plain_substring(docs, window=20):
    seen, out = set(), {}
    for i, text in sorted(docs):
        words = SPACE.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out[i] = (len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone))
    return out


@pytest.mark.parametrize("bucket_bytes", [12 << 20, 20_000])
def test_substring(make_docs, odd_texts, bucket_bytes):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(make_docs(odd_texts), bucket_bytes=bucket_bytes).collect()}
    assert got == plain_substring(list(enumerate(odd_texts)))
    assert sum(v[1] for v in got.values()) > 500


def test_substring_ids(make_docs):
    text = " ".join(prose(random.Random(3), 50))
    rows = remove_repeats(make_docs([text, text, text, None], [None, 4, 4, None])).collect()
    assert sorted((r["doc_id"] is None, r["n_words"], r["n_removed"]) for r in rows) == [(False, 50, 0), (False, 50, 0), (True, 0, 0), (True, 50, 50)]
    assert remove_repeats(make_docs([])).count() == 0


# --- op8 --------------------------------------------------------------------------------------


def plain_bytes(docs, window=400):
    places, out = {}, {}
    for _, text in docs:
        b = (text or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            places[w] = places.get(w, 0) + 1
    for i, text in docs:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if places[b[p : p + window]] > 1:
                gone[p : p + window] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        out[i] = (len(b), int(gone.sum()), int((edge == 1).sum()), bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("bucket_bytes", [4 << 20, 10_000])
def test_suffix(make_docs, odd_texts, bucket_bytes):
    out = remove_repeated_bytes(make_docs(odd_texts), bucket_bytes=bucket_bytes)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in out.collect()}
    assert got == plain_bytes(list(enumerate(odd_texts)))
    assert sum(v[1] for v in got.values()) > 3000


def test_suffix_periods(make_docs):
    rng = random.Random(8)
    unit = "".join(rng.choice("abc ") for _ in range(37))
    texts = [unit * 30, "q" + (unit * 30)[11:420] + "z", (unit * 12)[:430], "x" * 405, "y" + "x" * 400 + "y", "ä" * 333, unit[:20] * 21]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in remove_repeated_bytes(make_docs(texts)).collect()}
    assert got == plain_bytes(list(enumerate(texts)))


def test_suffix_ids(make_docs):
    text = " ".join(prose(random.Random(3), 200))
    rows = remove_repeated_bytes(make_docs([text, text, None, "b" * 10], [4, 4, None, None])).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (10, 0), (len(text), 0), (len(text), 0)]
    assert remove_repeated_bytes(make_docs([])).count() == 0


def test_sort_suffixes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    start = rng.integers(0, 3900, 300)
    size = rng.integers(0, 100, 300)
    group = np.sort(rng.integers(0, 9, 300))
    order, lcp = sort_suffixes(data, start, size, group)
    text = [bytes(data[s : s + n]) for s, n in zip(start, size)]
    assert [(group[i], text[i]) for i in order] == sorted((g, t) for g, t in zip(group, text))
    for at in range(1, 300):
        x, y = text[order[at - 1]], text[order[at]]
        shared = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
        assert lcp[at] == (shared if group[order[at]] == group[order[at - 1]] else -1)


# --- op2 --------------------------------------------------------------------------------------


def plain_components(docs, similarity=85):
    sets = {}
    for i, text in docs:
        w = SPACE.findall(lower(text))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def near_texts(seed, copies=60, changes=4):
    """Copies of one text that differ from it a little, and from each other by twice as much."""
    rng = random.Random(seed)
    base = prose(rng, 260)
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for p in rng.sample(range(len(w)), rng.randint(1, changes)):
            w[p] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [256, 8])
@pytest.mark.parametrize("drop_base", [False, True])
def test_near(make_docs, odd_texts, monkeypatch, block, drop_base):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = odd_texts + near_texts(1)[drop_base:] + near_texts(2, 40, 7)[drop_base:]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(make_docs(texts)).collect()}
    assert got == plain_components(list(enumerate(texts)))


def test_near_ids(make_docs):
    text = " ".join(prose(random.Random(3), 50))
    rows = near_groups(make_docs([text, text.upper(), text, "", None], [None, 4, 4, None, 2])).collect()
    assert sorted((r["n_shingles"], r["component_id"] or -1) for r in rows) == [(0, -1), (0, 2), (46, 4), (46, 4), (46, 4)]
    assert near_groups(make_docs([])).count() == 0


def test_setsketch():
    rng = np.random.default_rng(2)
    sketch = SetSketch(512)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (3000, 400, 700))
    ra, rb = (sketch.registers(np.concatenate((shared, x))) for x in (a, b))
    assert (merged(ra, rb) == sketch.registers(np.concatenate((shared, a, b)))).all()
    j = jaccard(np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()]), np.array([(ra == rb).sum()]), np.array([3400]), np.array([3700]))
    assert abs(j[0] - 3000 / 4100) < 0.07
    assert (sketch.registers(shared[:0]) == 0).all()


# --- op4 --------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot_share", [500, 3])
def test_exact(make_docs, odd_texts, hot_share):
    texts = odd_texts + ["a b", "ab", " ab", "a\tb"] * 6
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_groups(make_docs(texts), hot_share=hot_share).collect()}
    groups = {}
    for i, x in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", x or ""), []).append(i)
    want = {}
    for norm, own in groups.items():
        keep = min(own, key=lambda i: (-len(texts[i] or ""), i))
        want |= {i: (keep, len(own), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for i in own}
    assert got == want


def test_exact_ids(make_docs):
    rows = exact_groups(make_docs(["a", "a ", "a", None, ""], [None, 3, 3, 5, None])).collect()
    assert sorted((r["keep_id"], r["group_size"]) for r in rows) == [(3, 3)] * 3 + [(5, 2)] * 2
    assert sum(r["kept"] for r in rows) == 2
    assert exact_groups(make_docs([])).count() == 0


# --- op6 --------------------------------------------------------------------------------------


def plain_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = PLAIN.findall(lower(text))
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    sizes, out = {len(w) for w in windows}, {}
    for i, text in docs:
        w, hit, found = PLAIN.findall(lower(text)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        out[i] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def test_contamination(spark, make_docs, odd_texts):
    rng = random.Random(6)
    items = [" ".join(prose(rng, 25)) for _ in range(30)] + ["", None, "one", "naïve", "two, three", "w1 w2 w3 w1 w2 w3 w1", " ".join(odd_texts[7].split()[20:45])]
    texts = odd_texts + [f"{' '.join(prose(rng, 30))} {items[n].upper()}! {' '.join(prose(rng, 5))}" for n in range(0, 30, 3)] + [items[1][:60], "w1-w2:w3;w1 w2 w3 w1 w2 w3"]
    rows = [(None if n == 4 else n % 33, x, 1) for n, x in enumerate(items)]
    bench = spark.createDataFrame(rows, "item_id long, text string, token long")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in find_contamination(make_docs(texts), bench).collect()}
    assert got == plain_contamination(list(enumerate(texts)), [r[:2] for r in rows])
    assert all(r["n_hit"] == 0 for r in find_contamination(make_docs(texts), bench.limit(0)).collect())
    assert find_contamination(make_docs([]), bench).count() == 0


# --- op9 --------------------------------------------------------------------------------------


def test_bpe(make_docs, odd_texts):
    from tokenizers import Tokenizer

    rng = random.Random(1)
    letters = "abehtin ABC  ''\n\t\r\x0b\x1c\x85\xa0 　éèñüß漢кт12½Ⅷ٣!?#$%&*|-_.,😀‍́\x00"
    texts = odd_texts + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    texts += ["<|endoftext|>a <|endoftext|> <|endoftext|>", "it's we'll  don't", " " * 50 + "x", "�﻿"]
    path = tokenizer_path()
    known = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in encode_decode(make_docs(texts), path, columns=("n_tokens", "ids", "decoded", "ids_sha256")).collect()}
    for i, (text, want) in enumerate(zip(texts, known.encode_batch([x or "" for x in texts], add_special_tokens=False))):
        assert got[i]["ids"] == want.ids and got[i]["n_tokens"] == len(want.ids)
        assert got[i]["decoded"] == known.decode(want.ids, skip_special_tokens=False) == (text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, want.ids)).encode()).hexdigest()
    assert encode_decode(make_docs([]), path).count() == 0


def test_bpe_broken_bytes():
    bpe = load(tokenizer_path())
    assert bpe.decode(str(bpe.first[0xE4])) == "�" and bpe.decode("") == ""


def test_bpe_repeated_rows(make_docs):
    rows = encode_decode(make_docs(["a b", "a b", "c", None, None], [1, 1, 1, None, None]), tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in rows) == [(0, 0, ""), (0, 0, ""), (1, 1, "c"), (1, 2, "a b"), (1, 2, "a b")]


def test_bpe_keeps_frequent_pieces_when_it_forgets(monkeypatch):
    """A piece that every slice holds is encoded once, however many rare ones come and are forgotten."""
    from freshet.llm import bpe

    monkeypatch.setattr(bpe, "KNOWN_PIECES", 40)
    coder, learnt = bpe.Bpe(tokenizer_path()), []
    real = coder.encode_pieces
    monkeypatch.setattr(coder, "encode_pieces", lambda pieces: learnt.extend(pieces) or real(pieces))
    for n in range(30):
        coder.encode([" everywhere " + " ".join(chr(97 + n % 26) * (k + n // 26 + 1) for k in range(30))])
    assert learnt.count(b" everywhere") == 1 and learnt.count(b" ccc") == 2
    assert len(coder.known) + len(coder.older) <= 40 + 2 * 32


def test_bpe_lower_ranks_that_merges_make(tmp_path):
    """A merge may make a pair that ranks before it; pieces of equal letters, of one letter and long ones beside it."""
    from tokenizers import Tokenizer

    from freshet.llm.bpe import Bpe, byte_alphabet

    rng = random.Random(9)
    for trial in range(25):
        vocab, merges = {c: i for i, c in enumerate(byte_alphabet())}, []
        made = list("abc")
        while len(merges) < 40:
            a, b = rng.choice(made), rng.choice(made)
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
                made.append(a + b)
        rng.shuffle(merges)
        level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False}
        spec = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level}
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(spec | {"model": model | {"vocab": vocab, "merges": merges}}), encoding="utf-8")
        texts = [" ".join("".join(rng.choice("abc") for _ in range(rng.choice((1, 3, 9, 60)))) for _ in range(40)), "a" * 301, "b", ""]
        want = [x.ids for x in Tokenizer.from_file(str(path)).encode_batch(texts)]
        assert [x.tolist() for x in Bpe(str(path)).encode(texts)] == want


def test_near_packs_texts_once_and_few_links_take_no_rounds(make_docs, monkeypatch):
    """Whole texts are packed and dealt out once, however many levels and comparisons follow; few links are joined in one task."""
    calls = []

    def counted(module, name):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *args: calls.append(name) or real(*args))

    counted(near_dedup, "_texts_of")
    counted(components_of, "_large")
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = near_texts(1) + near_texts(2, 40, 7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(make_docs(texts)).collect()}
    assert calls == ["_texts_of"]
    monkeypatch.setattr(components_of, "TASK_EDGES", 0)
    assert got == {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(make_docs(texts)).collect()}
    assert "_large" in calls


@pytest.mark.parametrize("task_edges", [0, 1 << 18])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components_of, "TASK_EDGES", task_edges)
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9), (9, 7), (5, 5), (None, 4), (-1, 40), (40, 30)]
    edges = spark.createDataFrame(chain, "a long, b long").selectExpr("CAST(CAST(a + 1000 AS STRING) AS BINARY) AS a", "CAST(CAST(b + 1000 AS STRING) AS BINARY) AS b")
    got = {int(r.node) - 1000: int(r.root) - 1000 for r in components_of.components(edges).collect()}
    # as bytes, 1000 + 100 and beyond begin with 11 and so on, and 999 comes last
    assert got == {i: 100 for i in range(101, 161)} | {7: 3, 9: 3, -1: 30, 40: 30}
    assert components_of.components(edges.where("false")).count() == 0


def test_near_holds_little_text_at_once():
    bands, n = near_dedup.Bound(80).bands, 4000
    ids = pa.array(range(n))
    batch = pa.RecordBatch.from_arrays([ids, ids, ids, pa.array(["Plain words of a text. " * 75 + str(i) for i in range(n)])], ["id", "k", "t", "text"])
    for some in (batch.slice(0, 1), batch):
        tracemalloc.start()
        sketched = [b.select(["node", "registers"]) for b in near_dedup._sketch(iter([some]), bands)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert peak < 48 << 20  # for 7 MB of text
    whole = pa.Table.from_batches(sketched).combine_chunks().to_batches()
    got = [pa.Table.from_batches(near_dedup._bands(iter(b), bands, near_dedup.ROWS)) for b in (whole, sketched)]
    assert got[0].equals(got[1]) and got[0].num_rows == n * bands
    assert max(b.num_rows for b in near_dedup._bands(iter(whole), bands, near_dedup.ROWS)) < 60_000
