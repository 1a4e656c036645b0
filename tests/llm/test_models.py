"""Trained operators: held-out accuracy on the test tables, determinism, odd rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm.labelmodel import ABSTAIN, fit_label_model, fit_linear
from freshet.llm.quality import WIDTH, _examples, _sample, _scores, classify_quality
from freshet.llm.toxicity import classify_toxicity

SF = "/root/testdata/sf0.1"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.3
    accuracies = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(6000) < 0.3, ABSTAIN, np.where(rng.random(6000) < a, y, ~y)) for a in accuracies], axis=1)
    model = fit_label_model(votes, 0.4, rounds=300)
    told = model.emit[1, :, 1] / (model.emit[1, :, 0] + model.emit[1, :, 1])
    assert np.abs(told - accuracies).max() < 0.08 and abs(model.prior - 0.3) < 0.08
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.88


def test_copies_of_a_voter_share_their_weight():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.5
    one, other = (np.where(rng.random(4000) < a, y, ~y) for a in (0.7, 0.7))
    votes = np.stack([one, one, one, one, other], axis=1).astype(int)
    model = fit_label_model(votes, 0.5, correlated=True)
    assert model.weight[:4].max() < 0.4 and model.weight[4] > 0.9


def test_linear():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 3))
    y = 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))
    w, b = fit_linear(x, y, l2=0, rounds=2000)
    assert np.abs(w - [2, -1, 0]).max() < 0.1 and abs(b - 0.5) < 0.1


def test_toxicity_held_out(spark):
    out = classify_toxicity(read(spark, "documents"), read(spark, "labels")).cache()
    told = out.where("held_out").join(read(spark, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in told}
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0] and n[1, 1] >= 0.7 * (n[1, 1] + n.get((1, 0), 0))
    assert out.count() == read(spark, "documents").count()
    assert out.where("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def test_toxicity_never_learns_from_held_out_labels(spark):
    docs, labels = read(spark, "documents"), read(spark, "labels")
    lies = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (classify_toxicity(docs, x).agg(F.sum("score"), F.sum("predicted")).first() for x in (labels, lies))
    assert a == pytest.approx(b)


def test_quality_against_labels(spark):
    out = classify_quality(read(spark, "documents"))
    told = out.join(read(spark, "labels"), "doc_id").groupBy("quality", "keep").count().collect()
    n = {(r["quality"], r["keep"]): r["count"] for r in told}
    assert n.get((1, False), 0) <= 0.002 * n[1, True] and n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0))


def test_odd_rows(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts, [None, *range(len(odd_texts) - 2), 1])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        scores = [r["score"] for r in classify_toxicity(docs, some).collect()]
        assert len(scores) == len(odd_texts) and all(0 <= s <= 1 for s in scores)
    rows = classify_quality(docs).collect()
    assert len(rows) == len(odd_texts) and sum(r["quality_score"] == 0 and not r["keep"] for r in rows) == 3
    assert classify_quality(make_docs([])).count() == 0 and classify_toxicity(make_docs([]), labels).count() == 0


def test_quality_fit_depends_on_texts_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one = docs.where("text IS NOT NULL").orderBy("doc_id").limit(1)
    copies = one.withColumn("doc_id", F.explode(F.sequence(F.lit(10_000), F.lit(10_900)))).select("doc_id", "text")
    many = docs.unionByName(copies)
    scores = []
    for rows in (docs.repartition(1), many.repartition(7), many.repartition(3, "text")):
        scores.append({r["doc_id"]: r["quality_score"] for r in classify_quality(rows, fit_rows=60).where("doc_id < 10000").collect()})
    # 901 copies of one text, and other partitions, leave the fit on 60 distinct texts as it is
    for other in scores[1:]:
        assert other.keys() == scores[0].keys() and max(abs(x - other[i]) for i, x in scores[0].items()) < 1e-9
    assert _sample(docs, "text", 60).count() == 60 and _sample(docs.limit(0), "text", 60).count() == 0


def test_linear_fit_in_one_type():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 20)) < 0.3).astype(np.float32)
    y = 1 / (1 + np.exp(-(x @ rng.normal(size=20) - 0.5)))
    got, b = fit_linear(x, y, l2=1e-6, rounds=1500)
    want, c = fit_linear(x.astype(float), y, l2=1e-6, rounds=1500)
    assert np.abs(got - want).max() < 0.02 and abs(b - c) < 0.02


def test_quality_measures_little_text_at_once():
    text = "Plain words of a text, 12 of them. " * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([text] * 2000)], ["h", "text"])
    few = batch.slice(0, 1)
    for measure in (lambda b: _scores(b, (np.ones(WIDTH), 0.0), "text"), lambda b: sum(x.nbytes for x in _examples(iter([b])))):
        measure(few)
        tracemalloc.start()
        measure(batch)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20  # for 7 MB of text
    scores = _scores(batch, (np.ones(WIDTH), 0.0), "text")
    assert np.allclose(scores, _scores(few, (np.ones(WIDTH), 0.0), "text")[0], rtol=0, atol=1e-9)
