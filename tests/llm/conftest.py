import random

import pytest

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents: nulls, empty and long texts, copies, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = "Shared passage, " + prose(rng, 30)
    rows = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "!!! ???"), (6, "one two"), (7, "One, TWO"), (8, prose(rng, 20_000)),
        (9, f"{prose(rng, 40)} {passage} {prose(rng, 40)}"), (10, f"{prose(rng, 40)} {passage} {prose(rng, 40)}"), (11, "ünïcode ▁ wörds  and\ttabs\n\nlines " * 3),
        (12, prose(rng, 60)), (12, prose(rng, 60)), (13, base), (13, base), (None, base), (None, "no id, " + prose(rng, 30)), (14, "x" * 300), (15, passage),
    ]
    out = [(i, t, "en", None, len(t or ""), "clash", 7, 0.5, [1], 1, 2) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk string, node long, score double, features array<int>, words long, bucket long"
    return spark.createDataFrame(out, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
