"""Token files: round trips through blocks, planes and masks, and against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from freshet.llm import token_files as tf
from freshet.llm.queries import WORD_TOKENIZER, tokenizer_path
from freshet.session import scratch_dir

PATH = tokenizer_path(WORD_TOKENIZER)


@pytest.mark.parametrize("planes", ["bytes", "bits"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes(planes, n):
    ids = np.random.default_rng(n).integers(0, 2**32 if n % 2 else 50_000, n, np.uint32)
    rows = tf.to_planes(ids, planes)
    assert len(rows) == (32 if planes == "bits" else 4)
    assert np.array_equal(tf.from_planes(rows, n, planes), ids)
    docs, places = np.array([5, -3, tf.NO_ID]), np.array([0, 3, 3])
    record = tf.block_record(2, 1, 100, ids, 9, docs, places, planes)
    head, again, d, p = tf.open_block(record)
    assert head == (2, 1, 100, n, 9) and np.array_equal(again, ids) and np.array_equal(d, docs) and np.array_equal(p, places)


def test_mark_is_masked():
    for body in (tf._MARK, b"x" + tf._MARK + b"y" + tf._MARK, tf._MARK[:-1], tf._MARK[:1], b"\n:end-of-token-record:"):
        record = tf._sealed((tf._BLOCK, 0, 0, 0, 0, 0, 0, 0, 0), body)
        assert (record + tf._MARK).find(tf._MARK) == len(record)
        assert tf._opened(record)[1] == body


def test_damage():
    record = tf.block_record(0, 0, 0, np.arange(50, dtype=np.uint32), 0, np.zeros(1, np.int64), np.zeros(1, np.int64), "bytes")
    for broken in (record[:-1], record + b"z", record[:70]):
        with pytest.raises(Exception):
            tf.open_block(broken)
    with pytest.raises(ValueError):
        tf.open_block(b"T" * 100)
    with pytest.raises(ValueError):
        list(tf._index_rows(iter([pa.RecordBatch.from_pydict({"value": [tf._sealed((tf._INDEX, 0, 0, 3, 0, 0, 0, 0, 0), tf.bundle(**{c: np.zeros(2) for c in "abcdef"}))]})])))


def wanted(texts, ids, end=1):
    enc = Tokenizer.from_file(PATH)
    rows = [(i, np.array([*enc.encode(x or "", add_special_tokens=False).ids, *([] if end is None else [end])], "<u4")) for i, x in zip(ids, texts)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    return rows


@pytest.mark.parametrize("planes, block_ids, file_ids", [("bytes", 64, 700), ("bits", 1000, 1 << 24), ("bytes", 1 << 16, 3000)])
def test_files(spark, make_docs, odd_texts, planes, block_ids, file_ids):
    texts = [*odd_texts, "it's 'S don't 12 ½ ﬁ ΑΣ ς́ é x\x1cy\x85z w", "<|endoftext|> a<|startoftext|>b", "İİ Ǆ", "a" * 300, "same", "́ ́x"]
    ids = [*range(50, 50 + len(texts) - 2), None, 3]
    path = scratch_dir(spark, "files-test")
    index = tf.write_tokens(make_docs(texts, ids), path, PATH, block_ids=block_ids, planes=planes, file_ids=file_ids)
    rows = wanted(texts, ids)
    flat = np.concatenate([x for _, x in rows])
    starts = np.cumsum([0, *(len(x) for _, x in rows)])
    want = [(i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, x), s in zip(rows, starts)]
    got = tf.read_tokens(spark, path).select("id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    sizes = index.orderBy("file", "block").collect()
    assert sum(r["n_ids"] for r in sizes) == len(flat) and all(r["n_ids"] == block_ids for r, after in zip(sizes, sizes[1:]) if after["file"] == r["file"])
    for a, b in ((0, 1), (60, 200), (len(flat) - 5, len(flat)), (0, len(flat)), (7, 7)):
        assert np.array_equal(tf.fetch_ids(spark, path, a, b), flat[a:b])


def test_repeated_and_empty(spark, make_docs):
    path = scratch_dir(spark, "files-test")
    tf.write_tokens(make_docs(["b c", "b c", "a", None, ""], [4, 4, 4, 4, None]), path, PATH, block_ids=2)
    got = sorted((r["start"], r["id"], r["n_tokens"]) for r in tf.read_tokens(spark, path).where("id IS NOT NULL").collect())
    assert [r[1] for r in got] == [4] * 4 and sorted(r[2] for r in got) == [1, 2, 3, 3]
    assert [a + n for a, _, n in got] == [*(a for a, _, _ in got[1:]), 9]
    for end, texts in ((1, []), (None, ["", None])):
        empty = scratch_dir(spark, "files-test")
        assert tf.write_tokens(make_docs(texts), empty, PATH, end=end).agg(F.sum("n_ids")).first()[0] in (None, 0)
        assert [r["n_tokens"] for r in tf.read_tokens(spark, empty).collect()] == [0] * len(texts)
    with pytest.raises(ValueError):
        tf.write_tokens(make_docs(["a"]), scratch_dir(spark, "files-test"), PATH, planes="nibbles")


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_WORDS", 3)
    enc, plain = tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    assert enc.direct
    letters = "".join(map(chr, range(0xC0, 0x180)))
    texts = ["one two three four five", "one six", "x" * 500 + " one", "", letters, " ".join(letters), ". a., A.b; it's É! Él? ß. µ ª º ÷ × (a) a() ñ\u0303 e\u0301."]
    for text in texts:
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
    assert b"x" * 500 not in enc.known


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        tf.WordEncoder(tokenizer_path())
