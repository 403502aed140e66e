"""The classifiers' scores against the same formulas in plain Python, row by row."""

import math
import re
import zlib

import numpy as np

from pointmill.llm import quality_rank, toxicity


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_toxicity_scores_equal_the_formula(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300, "idiot " * 3 + "ÏDIOT_idiots 語言" * 90), (301, "a" * 200), (302, "_ - !")], "doc_id long, text string"))
    texts = [t for _, t in rows_of(more)]
    m = toxicity.train(texts + ["you idiot"] * 20, np.array([0] * len(texts) + [1] * 20))

    def word(w):
        grams = {f"<{w}>"} | {f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n)}
        return sum(float(m.weight[zlib.crc32(g.encode()) % toxicity.BUCKETS]) for g in grams) / len(grams)

    def score(t):
        found = [(math.ceil(len(w) / 64), w) for w in re.findall(r"[^\W_]+", t.lower())]
        z = sum(n * word(w) for n, w in found) / max(80, sum(n for n, _ in found)) + m.bias
        return 1 / (1 + math.exp(-z))

    got = sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(more, m).collect())
    want = sorted((str(i), score(t)) for i, t in rows_of(more))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)


def test_quality_scores_equal_the_formula(spark, docs):
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(300, "BIG!!! | $$$ 123\n\nwords, words; words."), (301, "é" * 5000), (302, " \t\n")], "doc_id long, text string"))
    weights = np.linspace(-2, 3, len(quality_rank.FEATURES)).round(3)
    ranking = quality_rank.Ranking(weights.tolist(), 0.25)

    def features(t):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        n, chars = max(len(words), 1), max(len(t), 1)
        count = lambda s: sum(c in s for c in t)
        return [
            min(count("#*$%&<>") * 5 / n, 1), min(count("|") * 5 / n, 1), min(count("!") * 2 / n, 1), min(count("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ") * 2 / chars, 1), min(count("0123456789") * 5 / chars, 1),
            min(count(".?,;:") * 2 / n, 1), min(count("\n") * 4 / n, 1), min((len(t) - count(" \t\n\r")) / n / 20, 1), min(len(set(words)) / n**0.75, 1), min(20 / n, 1),
        ]

    score = lambda t: 1 / (1 + math.exp(-(float(weights @ features(t)) - 0.25 + math.log(0.3 / 0.7))))
    got = sorted((str(r["doc_id"]), r["text"] or "", r["quality"]) for r in quality_rank.score(more, ranking, "quality").collect())
    want = sorted((str(i), t, score(t)) for i, t in rows_of(more))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-9)
