"""No row, no character and no position is left out."""

import random
import zlib

import numpy as np

from pointmill.llm import quality_rank, toxicity


def test_long_words_are_read_to_their_end(spark):
    for w in ("ab" * 40 + "idiot" + "語言" * 50 + "é😀x", "x" * 65):
        grams = {f"<{w}>", *(f"<{w}>"[i : i + n] for n in (3, 4, 5) for i in range(len(w) + 3 - n))}
        assert sorted(toxicity.buckets_of(w)) == sorted(zlib.crc32(g.encode()) & (toxicity.BUCKETS - 1) for g in grams)
    rng = random.Random(5)
    bad = [rng.random() < 0.5 for _ in range(160)]
    plain = lambda n: "".join(rng.choices("的一是不了人我在有他这为之大来以个中上们", k=n))
    texts = [plain(150) + ("笨蛋白痴" * 10 if b else plain(40)) + plain(100) for b in bad]
    m = toxicity.train(texts[:120], np.array(bad[:120], np.int64))
    rows = spark.createDataFrame(list(enumerate(texts[120:])), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] > 0.5 for r in toxicity.score(rows, m).collect()}
    assert np.mean([got[k] == b for k, b in enumerate(bad[120:])]) >= 0.9


def test_sample_of_labels_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 20, f"text {k:03}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 20, k % 2) for k in range(40)], "doc_id long, toxic int")
    got = toxicity.sample_labelled(docs, labels, "toxic", 5, {1: 3, 0: 4})
    assert sorted(y for _, y in got) == [0] * 4 + [1] * 3
    assert all(int(t.split()[1]) < 20 for t, _ in got)

    seen = []
    fit_pairs = quality_rank.fit_pairs
    monkeypatch.setattr(quality_rank, "fit_pairs", lambda x, y: seen.append(y.tolist()) or fit_pairs(x, y))
    quality_rank.fit(docs, labels.withColumnRenamed("toxic", "quality"), per_class=3)
    assert [sorted(y) for y in seen] == [[0, 0, 0, 1, 1, 1]]
