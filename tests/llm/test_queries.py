"""Registered queries against their SQL, archives, and the pipeline stage by stage against plain versions."""

import base64
import gzip
import hashlib

import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from freshet.llm.queries import ORACLES, QUERIES
from freshet.llm.warc import read_warc, records_in, resolved, write_warc
from freshet.session import scratch_dir
from test_text import plain_components, plain_contamination

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == []


def test_contract():
    known = contract.queries()
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_chat_query_keeps_every_turn(spark):
    got = QUERIES["op7_chat_format"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/conversations.parquet").count()


# --- archives ---------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, record_type string, date string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives(spark):
    rows = [
        (5, "http://a/1", "<p>é\r\n\r\nWARC/1.1</p>"), (3, "http://a/ 2\n", "<p>é\r\n\r\nWARC/1.1</p>"), (9, None, None), (8, "u", ""),
        (None, "n", "<p>é\r\n\r\nWARC/1.1</p>"), (None, "m", "only"), (4, "big", "x" * 3_000_000), (4, "big", "x" * 3_000_000), (7, "c", "x" * 3_000_000), (6, "d", "\r\n\r\n"),
    ]
    path = scratch_dir(spark, "warc-test")
    write_warc(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES), path, "2024-01-01T00:00:00Z")
    got = sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in resolved(read_warc(spark, path)).collect()), key=repr
    )
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        top = first.get(html or "")
        revisit = top is not None and i != top
        want.append((i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=repr)


def test_small_payloads_stay_responses(spark):
    path = scratch_dir(spark, "warc-test")
    rows = [(1, "a", "tiny", "", ""), (2, "b", "tiny", "", ""), (3, "c", "a longer one", "", ""), (4, "d", "a longer one", "", "")]
    write_warc(spark.createDataFrame(rows, PAGES), path, "2024-01-01T00:00:00Z", min_bytes=5)
    assert {r["page_id"]: r["refers_to"] for r in resolved(read_warc(spark, path)).collect()} == {1: None, 2: None, 3: None, 4: 3}
    empty = scratch_dir(spark, "warc-test")
    write_warc(spark.createDataFrame([], PAGES), empty, "2024-01-01T00:00:00Z")
    assert read_warc(spark, empty).count() == 0


def test_reader_takes_members_and_rejects_damage():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    members = gzip.compress(record) + gzip.compress(record)
    for content in (record + record, members, gzip.compress(record + record)):
        assert [b for _, b in records_in(content)] == [b"ab\r\nc"] * 2
    for broken in (record[:-7], b"junk\r\n\r\n", members[:-30]):
        with pytest.raises(Exception):
            list(records_in(broken))


# --- pipeline ---------------------------------------------------------------------------------


def run_stage(spark, n, docs):
    path = scratch_dir(spark, "stage")
    corpus_pipeline.STAGES[n][1](spark, docs, SF).write.parquet(path)
    return spark.read.parquet(path)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = run_stage(spark, 0, docs)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert {i for i, q in labels.items() if q == 1} <= kept and len(kept & {i for i, q in labels.items() if q == 0}) <= 1

    first = {}
    for r in good.collect():
        norm = "".join((r["text"] or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
        first.setdefault(norm, []).append((-len(r["text"]), r["doc_id"]))
    exact = run_stage(spark, 1, good)
    assert {r["doc_id"] for r in exact.collect()} == {min(x)[1] for x in first.values()}

    near = run_stage(spark, 2, exact)
    want = plain_components([(r["doc_id"], r["text"]) for r in exact.collect()], corpus_pipeline.SIMILARITY)
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, _, keep) in want.items() if keep}

    clean = run_stage(spark, 3, near)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    told = plain_contamination([(r["doc_id"], r["text"]) for r in near.collect()], items)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, (_, hit, _) in told.items() if not hit}
    assert all(x.columns == columns for x in (good, exact, near, clean))

    out = run_stage(spark, 4, clean)
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"]: r["decoded_sha256"] for r in out.collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in texts.items()}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_pipeline_takes_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs([*odd_texts, odd_texts[7]], [None, None, *range(len(odd_texts) - 2), 5]).withColumnRenamed("lang", "_kept")
    for n in range(5):
        docs = run_stage(spark, n, docs)
    assert docs.count() <= len(odd_texts)
    none = make_docs([])
    for n in range(5):
        none = run_stage(spark, n, none)
    assert none.count() == 0


def test_pipeline_links_from_80_per_cent(spark, make_docs):
    base = [f"w{n}" for n in range(300)]

    def copy(*places):
        return " ".join("new" if n in places else w for n, w in enumerate(base))

    # of 296 shingles every change takes 5: similarities of 0.844, 0.816 and 0.762
    texts = [" ".join(base), copy(*range(20, 270, 50)), copy(*range(20, 270, 45)), copy(*range(20, 270, 32)[:8])]
    assert sorted(r["doc_id"] for r in run_stage(spark, 2, make_docs(texts)).collect()) == [0, 3]


def test_pipeline_decides_by_row(spark, make_docs):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b = (" ".join(f"{x}{n}" for n in range(300)) for x in "ab")
    near_a = a.replace("a150 ", "other ")
    rows = [(1, a), (1, a), (1, b), (2, near_a), (0, b), (None, "c d e"), (None, "c d e"), (None, "c d  e"), (4, None), (4, ""), (3, "fine"), (3, "x " + item)]
    docs = make_docs([x for _, x in rows], [i for i, _ in rows])

    def left(n, docs):
        out = run_stage(spark, n, docs)
        assert out.columns == docs.columns
        return out, sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)

    # equal rows are one, and a copy goes although another row of its identifier stays
    exact, got = left(1, docs)
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (2, near_a), (0, b), (None, "c d  e"), (3, "fine"), (3, "x " + item)], key=repr)
    assert len([x for x in got if x[0] == 4]) == 1
    _, got = left(2, docs)
    assert [x for x in got if x[0] not in (4, None)] == sorted([(1, a), (0, b), (3, "fine"), (3, "x " + item)], key=repr)
    assert len([x for x in got if x[0] == 4]) == 1 and len([x for x in got if x[0] is None]) == 1
    # within one identifier, too
    _, got = left(2, make_docs([a, near_a], [1, 1]))
    assert len(got) == 1
    # only the contaminated row goes; repeated clean rows are not this stage's to decide
    _, got = left(3, docs)
    assert got == sorted([x for x in rows if x[1] != "x " + item], key=repr)


def test_pipeline_bounds_batches(spark):
    own, key = spark.newSession(), "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = own.range(6000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some text "), 200).alias("text"))
    corpus_pipeline.tokens(own, docs, SF)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    n = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(n) > 12_000_000 and max(n) < 5 << 20
    own.conf.set(key, "1m")
    corpus_pipeline.tokens(own, docs, SF)
    assert own.conf.get(key) == "1m"
