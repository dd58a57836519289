import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF_DIR = "/root/testdata/sf0.001"
# Names that the operators use inside.
CLASHING = ["key", "chunk", "n", "value", "comp", "score", "part", "item", "kept", "start", "bucket"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or ""), *(["x"] * len(CLASHING))) for i, t in zip(ids, texts)]
        extra = ", ".join(f"{c} string" for c in CLASHING)
        frame = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")
        return frame.repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts with copies, near copies, shared passages, odd blanks, empty, null and very long ones."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = make(60)
    texts = [None, "", "   \n\t ", "one", "one", "One  TWO\nthree", "one two three", "x" * 5000]
    base = make(120)
    for _ in range(25):  # near copies, some just below and some just above the limit
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    texts += [" ".join(base)] * 5 + [" ".join(base).upper()]
    for _ in range(15):
        texts.append(" ".join(make(rng.randint(5, 90)) + passage[: rng.randint(30, 60)] + make(rng.randint(0, 40))))
    for _ in range(15):
        texts.append("\n".join(make(rng.randint(1, 150))) + "\u00a0end\x1c x")
    texts.append(" ".join(make(9000) + passage + passage))
    return texts
