import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# extra columns carry names that the operators use inside
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, k string, t string, z string, node string, n string, kept string, spans string, _norm string"


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, x, "en", "s", None, 7, "k", "t", "z", "n", "n", "k", "s", "x") for i, x in zip(ids, texts)], SCHEMA)

    return make


def prose(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture
def odd_texts():
    """Null, empty, blank, tiny, repeated, very long, odd white space, mixed scripts, and passages in common."""
    rng = random.Random(11)
    passage = " ".join(prose(rng, 90))
    texts = [None, "", "  \n\t ", "one", "one", "One  two\x0bthree\x1cfour", "Äpfel ÉTÉ 漢字 😀 naïve"]
    texts += [" ".join(prose(rng, 60)) + "\n" + passage + " " + " ".join(prose(rng, 40)) for _ in range(5)]
    texts += [passage, passage.upper(), passage.replace(" ", "  \n"), texts[8], texts[8] + " "]
    texts += ["Er " * 500, "abc" * 700, "x" * 3000, "a b " * 9000, " ".join(prose(rng, 8000, 50000))]
    return texts
