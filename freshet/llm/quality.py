"""Quality classifier without hand labels.

Heuristic labellers vote on a bounded sample of documents, or abstain; expectation-maximisation estimates how far to trust
each, and the posterior labels train a linear scorer on hashed word shapes, which then scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import ABOVE, IS_SPACE, hash_spans, mix, padded, raw, slices, words
from freshet.llm.labelmodel import ABSTAIN, fit_label_model, fit_linear

# distinct texts that the model is fitted on; scoring covers all documents
FIT_ROWS = 8_000
WIDTH = 1 << 10  # hashed features
# bytes of text that are measured at once, which takes about 65 times as many bytes of memory
SLICE_BYTES = 512 << 10
PRIOR = 0.85  # share of good documents to start from
REJECT_BELOW = 0.5
BELIEF, SHRINK = 10.0, 0.1  # both count rows, and so matter only in small samples
# A handful of words decides little: STEADY is added to every text's length, and the score starts at this log-odds.
STEADY, WORDLESS = 8, 2.0

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 sentence mark, 5 symbol, 0 white space and control
_KIND[33:127] = 5
_KIND[[ord(c) for c in ".,;:'\"?!()-"]] = 4
_KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[128:] = 3, 2, 1, 1


def _letters(data: np.ndarray) -> np.ndarray:
    """The kind of every byte; bytes beyond ASCII are letters, capital ones where the Latin-1 block says so."""
    kind = _KIND[data]
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & ABOVE[data[1:]]
    kind[capital] = 2
    return kind


def _measure(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """A shape code per word, first words of rows, and what the labellers look at, by row."""
    data, offsets = raw(part.column("text"))
    ws, we, wo = words(data, offsets)
    kind = _letters(data)
    counts = {k: np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32))) for k in (1, 2, 3, 4, 5)}
    of = {k: c[we] - c[ws] for k, c in counts.items()}
    h = hash_spans(padded(data), ws, we)
    same = np.zeros(len(ws), bool)
    same[1:] = h[1:] == h[:-1]
    same[wo[:-1][wo[:-1] < len(ws)]] = False
    title = kind[ws] == 2 if len(ws) else np.zeros(0, bool)
    case = np.select([of[1] + of[2] == 0, of[2] == 0, (of[1] == 0) & (of[2] > 1), title & (of[2] <= 2)], [0, 1, 2, 3], 4)
    size = np.searchsorted([1, 3, 6, 10, 16, 30], we - ws)
    code = ((((case * 4 + np.minimum(of[5], 3)) * 4 + np.minimum(of[4], 3)) * 2 + (of[3] > 0)) * 7 + size) * 2 + same
    n = np.diff(wo)
    total = {k: c[offsets[1:]] - c[offsets[:-1]] for k, c in counts.items()}
    some = np.maximum(n, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate(([0], np.cumsum(flags)))
        return (c[wo[1:]] - c[wo[:-1]]) / some

    shown = np.maximum(sum(total.values()), 1)
    facts = {
        "words": n,
        "capitals": total[2] / np.maximum(total[1] + total[2], 1),
        "letters": (total[1] + total[2]) / shown,
        "symbols": total[5] / shown,
        "marks": total[4] / some,
        "repeats": share(same),
        "wordless": share(case == 0),
        "short": share(we - ws <= 3),
        "long": share(we - ws > 30),
        "lower": share(case == 1),
    }
    return code, wo, facts


def _votes(f: dict[str, np.ndarray]) -> np.ndarray:
    """A column per labeller: 0 poor, 1 good or ABSTAIN. Each looks for one fault; only the last two speak for a text."""
    some = f["words"] > 0
    faults = [
        f["capitals"] > 0.5,
        f["capitals"] > 0.3,
        f["letters"] < 0.7,
        f["symbols"] > 0.08,
        f["symbols"] > 0.03,
        f["marks"] > 1.2,
        f["repeats"] > 0.2,
        f["repeats"] > 0.4,
        f["wordless"] > 0.2,
        f["long"] > 0.2,
        some & (f["lower"] < 0.2),
        ~some,
    ]
    none = ~np.any(faults, axis=0)
    praise = [none & (f["lower"] > 0.5) & (f["repeats"] < 0.05), none & (f["short"] > 0.1) & (f["short"] < 0.9) & (f["letters"] > 0.85)]
    columns = [np.where(x, 0, ABSTAIN) for x in faults] + [np.where(x, 1, ABSTAIN) for x in praise]
    return np.stack(columns, axis=1).astype(np.int8)


def _slots(code: np.ndarray) -> np.ndarray:
    return (mix(code.astype(np.uint64) + np.uint64(1)) % np.uint64(WIDTH)).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            code, wo, facts = _measure(part)
            row = np.repeat(np.arange(part.num_rows), np.diff(wo))
            x = np.zeros((part.num_rows, WIDTH), np.float32)
            np.add.at(x, (row, _slots(code)), 1)
            x /= (facts["words"] + STEADY)[:, None]
            yield pa.RecordBatch.from_arrays(
                [part.column("h"), pa.array([v.tobytes() for v in _votes(facts)], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary())], ["h", "votes", "x"]
            )


def _scores(batch: pa.RecordBatch, model: tuple[np.ndarray, float], text_col: str) -> np.ndarray:
    """The score of every row of a batch."""
    w, b = model
    parts = [np.zeros(0)]
    for part in slices(batch, text_col, SLICE_BYTES):
        code, wo, facts = _measure(part.select([text_col]).rename_columns(["text"]))
        c = np.concatenate(([0.0], np.cumsum(w[_slots(code)])))
        value = (c[wo[1:]] - c[wo[:-1]]) / (facts["words"] + STEADY) + b
        parts.append(np.where(facts["words"] > 0, 1 / (1 + np.exp(-np.clip(value, -60, 60))), 0.0))
    return np.concatenate(parts)


def _sample(docs: DataFrame, text_col: str, fit_rows: int) -> DataFrame:
    """h, text: the ``fit_rows`` distinct texts with the least hashes, whatever the number of their copies."""
    texts = docs.select(F.xxhash64(F.lit("fit"), text_col).alias("h"), F.col(text_col).alias("text"))
    least = texts.select("h").distinct().orderBy("h").limit(fit_rows)
    bound = least.agg(F.max("h")).first()[0]
    if bound is None:
        return texts.where(F.lit(False))
    return texts.where(F.col("h") <= bound).groupBy("h").agg(F.first("text").alias("text"))


def fit_quality(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float]:
    """Weights by hashed shape and the intercept, from ``fit_rows`` distinct texts chosen by their hashes (all, if there are fewer).

    Copies of a text count once, so no text can fill the sample, and neither the order of rows nor their partitions change it.
    """
    got = _sample(docs, text_col, fit_rows).mapInArrow(_examples, "h long, votes binary, x binary").toPandas()
    if got.empty:
        return np.zeros(WIDTH), 0.0
    got = got.sort_values("h")
    votes = np.stack([np.frombuffer(v, np.int8) for v in got["votes"]])
    x = np.stack([np.frombuffer(v, np.float32) for v in got["x"]])
    model = fit_label_model(votes, PRIOR, smoothing=BELIEF)
    return fit_linear(x, model.posterior(votes), l2=SHRINK / len(x), rounds=600, intercept=WORDLESS)


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", score: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1, higher is better; 0 for texts without words)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(batch, model, text_col), pa.float64())], [*batch.schema.names, score])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{kinds}, `{score}` double")


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, reject_below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of ``docs``: id, quality_score and keep (score at or above ``reject_below``).

    Only the text is looked at. Null and empty texts score 0 and are rejected; repeated texts score alike; null ids and other
    columns change nothing. An empty table gives an empty one. The fit depends on the set of texts alone.
    """
    model = fit_quality(docs, text_col, fit_rows)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = score_quality(read, model).select("id", "quality_score", (F.col("quality_score") >= reject_below).alias("keep"))
    return out.withColumnRenamed("id", id_col)
