"""The quality ranking learns from every labelled row: weights against all pairs by brute force, the cut against a sort."""

import random

import numpy as np
import pytest

from pointmill.llm import quality_rank


@pytest.fixture(scope="module")
def judged(spark):
    """Documents of which symbols, capitals and repeats make bad ones likelier, and their labels; one row has no part in it."""
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(400):
        junk = rng.random()
        words = [rng.choice(["$$$", "BIG", "buy!", "same"]) if rng.random() < junk else f"word{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        docs.append((k, " ".join(words)))
        labels.append((k, int(junk + rng.gauss(0, 0.3) < 0.6)))
    docs += [(None, "no id"), (7, "~ more text of a repeated id"), (500, "not labelled")]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([*labels, (None, 1), (501, 0), (3, None)], "doc_id long, quality int")
    rows = quality_rank.labelled(docs, labels).collect()
    return docs, labels, np.array([r["features"] for r in rows]), np.array([r["label"] for r in rows])


def test_weights_are_of_all_pairs(judged):
    docs, labels, x, y = judged
    assert len(y) > 300
    rankings = [quality_rank.fit(docs, labels, per_class=n) for n in (3, 400)]
    assert rankings[0] == rankings[1]  # the sample is a start only
    w = np.array(rankings[0].weights)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    lost = 1 / (1 + np.exp(d @ w))
    assert np.abs(quality_rank.RIDGE * w - (d * lost[:, None]).mean(0)).max() < 1e-8


def test_sums_of_bins_equal_the_pairs():
    rng = np.random.default_rng(2)
    x, y, w = rng.random((200, 10)), rng.integers(0, 2, 200), rng.normal(size=10) * 6
    gradient, curve = quality_rank.slope(sum(quality_rank.bin_sums(x[k : k + 70], y[k : k + 70], w) for k in (0, 70, 140)), w, 0.5)
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, 10)
    p = 1 / (1 + np.exp(-d @ w))
    assert np.abs(gradient - (0.5 * w - (d * (1 - p)[:, None]).mean(0))).max() < 1e-12
    assert np.abs(curve - (d * (p * (1 - p))[:, None]).T @ d / len(d) - 0.5 * np.eye(10)).max() < 1e-4


def test_cut_is_of_all_rows(spark, judged, monkeypatch):
    docs, labels, x, y = judged
    ranking = quality_rank.fit(docs, labels, per_class=3)
    s = np.sort(x @ np.array(ranking.weights))
    assert (s < ranking.cut).sum() == (y == 0).sum()
    monkeypatch.setattr(quality_rank, "BINS", 4)  # several rounds
    for scores in ([0.5, 0.1, 0.3, 0.3, 0.3, 0.9, 0.2, 0.30000000000000004], [0.4] * 3, [0.0, 1.0], (np.random.default_rng(3).random(300) ** 9).tolist()):
        rows = spark.createDataFrame([([v],) for v in scores], "features array<double>")
        for n in range(len(scores) + 1)[:: max(1, len(scores) // 8)]:
            cut, some = quality_rank.with_cut(quality_rank.Ranking([1.0], -7.0), rows, n).cut, sorted(scores)
            under = [v for v in some if 0 < n < len(some) and v < some[n]]
            assert cut == (-7.0 if n in (0, len(some)) else (under[-1] + some[n]) / 2 if under else some[n])


def test_pipeline_cuts_at_the_share_of_all_rows(spark, judged, monkeypatch, tmp_path):
    import corpus_pipeline

    docs, labels, x, y = judged
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(quality_rank.fit, "__defaults__", (5, 3))  # a start from 3 rows of each class
    rows = {r["doc_id"]: np.array(r["features"]) for r in quality_rank.labelled(docs, labels).collect()}
    w = np.array(quality_rank.fit(docs, labels).weights)
    least = np.sort(x @ w)[(y == 0).sum()]
    kept = [r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, str(tmp_path)).collect()]
    assert {i for i in kept if i in rows and i != 7} == {i for i, f in rows.items() if f @ w > least - 1e-12 and i != 7}
