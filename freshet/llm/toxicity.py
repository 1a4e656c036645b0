"""Toxicity by weak supervision.

On a bounded sample of labelled training rows, a lexicon of words and word beginnings is mined; every entry is a voter, and so
are a few patterns and, as one more noisy voter, the hand label. A generative model estimates the voters' accuracies
and the correlations by which they would be counted twice, and a linear classifier on hashed words and word beginnings
learns from its posteriors. Scoring looks words up in the classifier's table and covers every text in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ABOVE, IS_BREAK, LOWER, eights, hash_spans, mix, padded, raw, slices, words
from freshet.llm.labelmodel import ABSTAIN, fit_label_model, fit_linear

FIT_ROWS = 8_000  # labelled rows that the model is fitted on, at most about
PREFIXES = (4, 5, 6, 7)  # bytes of word beginnings
SLOTS = 1 << 20
VOTERS = 120  # lexicon voters, at most
FEATURES = 1_500  # features of the classifier, at most
LEAST_ROWS = 4  # toxic rows that an entry must occur in
LEAST_ODDS, LEAST_SURE = 3.0, 4.0  # log-odds of an entry, and that in standard errors
HAND = 0.97  # accuracy given to hand labels; all other voters' accuracies are estimated
THRESHOLD = 0.7

# A few common insults, so that there are voters even where the sample has no toxic row.
SEEDS = "idiot idiots moron morons stupid scum loser losers trash pathetic worthless disgusting clown imbecile dumb".split()

_IS_BREAK = IS_BREAK.copy()
_IS_BREAK[48:58] = True  # digits


def held_out(id_col: str) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _lower(data: np.ndarray) -> np.ndarray:
    data = LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & ABOVE[data[1:]]) + 1
    data[capital] += 32
    return data


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash slots of words and word beginnings with their rows, and pattern facts by row (shouts, repeats of '!')."""
    data, offsets = raw(part.column("text"))
    lower = _lower(data)
    ws, we, wo = words(lower, offsets, _IS_BREAK)
    room = padded(lower)
    row = np.repeat(np.arange(part.num_rows), np.diff(wo))
    slots, rows = [hash_spans(room, ws, we)], [row]
    if len(ws):
        view = eights(room)
        for size in PREFIXES:
            # beginnings end between letters: no bytes of a longer character are cut off
            own = np.flatnonzero((we - ws > size) & ((room[np.minimum(ws + size, len(room) - 1)] & 0xC0) != 0x80))
            slots.append(mix((view[ws[own]] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size)))
            rows.append(row[own])
    slot = (np.concatenate(slots) & np.uint64(SLOTS - 1)).astype(np.int64)
    size = np.maximum(np.diff(offsets), 1)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    bang = np.concatenate(([0], np.cumsum(data == 33)))
    facts = np.stack([(c[offsets[1:]] - c[offsets[:-1]]) / size for c in (upper, bang)], axis=1)
    return slot, np.concatenate(rows), facts


def _presence(part: pa.RecordBatch, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, slot) pairs in order, only slots with a value in ``table`` if that is given."""
    slot, row, facts = _features(part)
    if table is not None:
        some = np.flatnonzero(table[slot])
        slot, row = slot[some], row[some]
    pair = np.unique(row * SLOTS + slot)
    return pair // SLOTS, pair % SLOTS, facts


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            row, slot, facts = _presence(part)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(lists, pa.binary()), pa.array([f.tobytes() for f in facts], pa.binary())], ["y", "slots", "facts"])


def _seed_slots() -> np.ndarray:
    part = pa.RecordBatch.from_arrays([pa.array(SEEDS)], ["text"])
    data, offsets = raw(part.column("text"))
    ws, we, _ = words(data, offsets, _IS_BREAK)
    return (hash_spans(padded(data), ws, we) & np.uint64(SLOTS - 1)).astype(np.int64)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights by slot and the intercept, from about ``fit_rows`` labelled rows that are not held out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "k"), F.lit(1_000_000)) < int(1_000_000 * fit_rows / total) + 1)
    # repeated ids repeat their rows: the limits keep both sides bounded, and so the broadcast
    known = known.limit(2 * fit_rows)
    read = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("text"))
    sample = read.join(F.broadcast(known), "k").select("y", "text").mapInArrow(_examples, "y int, slots binary, facts binary").limit(2 * fit_rows).toPandas()

    table = np.zeros(SLOTS)
    seeds = _seed_slots()
    if sample.empty:
        table[seeds] = 4.0
        return table, -2.5
    y = sample["y"].to_numpy()
    lists = [np.frombuffer(s, np.int32) for s in sample["slots"]]
    facts = np.stack([np.frombuffer(f, np.float64) for f in sample["facts"]])
    flat, row = np.concatenate(lists), np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    del sample, lists[1:]
    yes = np.bincount(flat[y[row] == 1], minlength=SLOTS)
    no = np.bincount(flat[y[row] == 0], minlength=SLOTS)
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    odds = np.log((yes + 0.3) / (n1 + 1)) - np.log((no + 1.0) / (n0 + 1))
    # strongest evidence first: how sure it is that an entry leans to toxic rows
    sure = np.where(yes >= LEAST_ROWS, odds / np.sqrt(1 / (yes + 0.3) + 1 / (no + 1.0)), 0)
    mined = np.flatnonzero((odds > LEAST_ODDS) & (sure > LEAST_SURE))
    mined = mined[np.argsort(-sure[mined], kind="stable")]
    chosen = np.unique(np.concatenate((mined[:FEATURES], seeds)))
    at = np.full(SLOTS, -1, np.int32)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((len(y), len(chosen)), np.float32)
    used = np.flatnonzero(at[flat] >= 0)
    x[row[used], at[flat[used]]] = 1

    voters = at[np.unique(np.concatenate((mined[:VOTERS], seeds)))]
    lexicon = np.where(x[:, voters] > 0, 1, ABSTAIN)
    none = np.where(x.any(axis=1), ABSTAIN, 0)[:, None]
    patterns = np.stack([np.where(facts[:, 0] > 0.5, 1, ABSTAIN), np.where(facts[:, 1] > 0.02, 1, ABSTAIN)], axis=1)
    votes = np.concatenate((lexicon, none, patterns, y[:, None]), axis=1).astype(np.int8)
    prior = float(np.clip((n1 + 1) / (n1 + n0 + 2), 0.01, 0.5))
    model = fit_label_model(votes, prior, correlated=True, known={votes.shape[1] - 1: HAND}, silence=False)
    posterior = model.posterior(votes)
    w, b = fit_linear(x, posterior, l2=2e-6, rounds=800)
    table[chosen] = w
    return table, b


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and score, from the whole text alone."""
    table, b = model
    slots = np.flatnonzero(table)
    few, weights = slots, table[slots]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(SLOTS)
        full[few] = weights
        for batch in batches:
            for part in slices(batch, "text"):
                row, slot, _ = _presence(part, full)
                value = np.bincount(row, full[slot], part.num_rows) + b
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(1 / (1 + np.exp(-np.clip(value, -60, 60))))], ["id", "score"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = read.schema["id"].dataType.simpleString()
    return read.mapInArrow(rows, f"id {kind}, score double").withColumnRenamed("id", id_col)


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted (1 from ``threshold`` on).

    Labels, identifiers and other columns never enter a score. Null and empty texts get the score of a text without
    evidence; repeated texts score alike; a null id is not held out and has no label. Labels other than 0 and 1, labels of
    unknown documents and null labels are ignored; without labels the seed words decide. Rows that repeat an id in
    ``labels`` count once each.
    """
    scored = score_toxicity(docs, fit_toxicity(docs, labels, id_col, text_col, label_col, fit_rows), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
