"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams and of itself, a document the mean of
its words; a linear softmax over two classes reads the document. Misspelt and derived words share
n-grams, so they share what was learnt. Training sees a bounded sample of labelled rows; scoring runs
in the tasks over all rows, each distinct word of a task being looked up once. A run of letters without
blanks is read to its end, and counts as a word for each LONG characters begun.

Nulls: a null text is empty; texts without words get the score of the bias alone. Labels that are null
are not learnt from; without both labels the score is the share of label 1. Repeated rows each get a row,
equal texts equal scores. An empty table gives no rows. Only id, text and the label are read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.llm import common

#: Labelled rows learnt from at most, by label.
SAMPLE = {1: 1500, 0: 2500}
BUCKETS, DIMENSIONS, ROUNDS, RATE, DECAY = 1 << 17, 4, 60, 0.1, 1e-5
#: Document means are small, as most words say nothing: they are scaled before the softmax.
GAIN = 60.0
#: An n-gram in this share of the sampled documents learns at half the rate, a rarer one more slowly still: a coincidence says little.
HALF_RATE = 0.003
#: A shorter text is averaged as if it had this many words, so that one odd word doesn't decide.
LEAST_WORDS = 80
#: Words of a task's lookup table; when full it is emptied.
TABLE_ROWS = 300_000

#: Longer words are hashed by columns, count as several words and stay out of the lookup table.
LONG = 64

_WORDS = re.compile(r"[^\W_]+")


def _crc_steps() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (t >> 1)
    return t


_CRC = _crc_steps()


def long_hashes(w: str) -> np.ndarray:
    """zlib.crc32 of w and of its distinct n-grams of 3 to 5 characters, a byte of all n-grams at a time."""
    data = np.frombuffer(w.encode(), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), data.size)
    found = [np.array([zlib.crc32(data)], np.uint32)]
    for n in (3, 4, 5):
        first, size = at[:-n], at[n:] - at[:-n]
        crc = np.full(first.size, 0xFFFFFFFF, np.uint32)
        for k in range(int(size.max())):
            byte = data[np.minimum(first + k, data.size - 1)]
            crc = np.where(size > k, _CRC[(crc ^ byte) & 0xFF] ^ (crc >> 8), crc)
        found.append(np.unique(~crc))
    return np.concatenate(found)


def buckets_of(word: str) -> list[int]:
    """Hash buckets of the word and of its n-grams of 3 to 5 characters, with marked ends."""
    w = f"<{word}>"
    if len(word) > LONG:
        return (long_hashes(w) & np.uint32(BUCKETS - 1)).tolist()
    grams = {w, *(w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1))}
    return [zlib.crc32(g.encode()) & (BUCKETS - 1) for g in grams]


def words_in(word: str) -> int:
    """As how many words it counts."""
    return -(-len(word) // LONG)


@dataclass
class Model:
    """A weight for each bucket (embedding times the difference of the two softmax rows) and the bias."""

    weight: np.ndarray
    bias: float

    def word(self, w: str) -> float:
        return float(self.weight[buckets_of(w)].mean())


def _segments(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Embeddings and softmax by full-batch Adam."""
    index: dict[str, int] = {}
    doc_n = np.zeros(len(texts), np.int64)
    word, share = array("i"), array("f")
    for d, t in enumerate(texts):
        counts = {w: n * words_in(w) for w, n in Counter(_WORDS.findall(t.lower())).items()}
        n_words = max(LEAST_WORDS, sum(counts.values()))
        word.extend(index.setdefault(w, len(index)) for w in counts)
        share.extend(n / n_words for n in counts.values())
        doc_n[d] = len(counts)
    if not index or len(set(labels.tolist())) < 2:
        p = (labels.sum() + 1) / (labels.size + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    word, share = np.frombuffer(word, np.int32), np.frombuffer(share, np.float32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), doc_n)
    sub, n_sub = array("i"), np.zeros(len(index), np.int64)
    for k, w in enumerate(index):
        found = buckets_of(w)
        sub.extend(found)
        n_sub[k] = len(found)
    n_words = len(index)
    del index
    sub = np.frombuffer(sub, np.int32)
    sub_word = np.repeat(np.arange(n_words, dtype=np.int32), n_sub)
    # documents that have each bucket: words of a document may repeat it, so this bounds it from above
    seen = np.bincount(sub, weights=np.bincount(word, minlength=n_words)[sub_word], minlength=BUCKETS)
    order = np.argsort(word, kind="stable").astype(np.int32)
    word_starts = _segments(np.bincount(word, minlength=n_words))
    rng = np.random.default_rng(seed)
    names, table = np.unique(sub, return_inverse=True)
    table = table.astype(np.int32)
    scale = (1.0 / n_sub[sub_word]).astype(np.float32)
    pace = (seen[names] / (seen[names] + HALF_RATE * len(texts))).astype(np.float32)
    emb = rng.normal(0, 0.05, (DIMENSIONS, names.size)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIMENSIONS, 2))
    bias = np.zeros(2)
    target = np.stack([1 - labels, labels], 1).astype(float)
    weight = np.where(labels == 1, 0.35 / max(1, labels.sum()), 0.65 / max(1, (1 - labels).sum()))
    sub_order = np.argsort(table, kind="stable").astype(np.int32)
    sub_starts = _segments(np.bincount(table, minlength=names.size))
    has_words = doc_n > 0
    sub_of_word, doc_starts = _segments(n_sub), _segments(doc_n)[has_words]
    back_doc, back_share = doc[order], share[order] * np.float32(GAIN)
    back_word, back_scale = sub_word[sub_order], scale[sub_order]
    share = share * np.float32(GAIN)
    del sub, sub_word, sub_order, order
    mean, d_emb = np.zeros((len(texts), DIMENSIONS)), np.zeros_like(emb)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (emb, soft, bias)]
    for step in range(1, ROUNDS + 1):
        for k in range(DIMENSIONS):
            vec = np.add.reduceat(emb[k][table] * scale, sub_of_word)
            mean[has_words, k] = np.add.reduceat(vec[word] * share, doc_starts)
        z = mean @ soft + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        dz = (p - target) * weight[:, None]
        d_mean = dz @ soft.T
        for k in range(DIMENSIONS):
            d_word = np.add.reduceat(d_mean[:, k].astype(np.float32)[back_doc] * back_share, word_starts)
            d_emb[k] = np.add.reduceat(d_word[back_word] * back_scale, sub_starts)
        for x, g, s, rate in zip((emb, soft, bias), (d_emb + DECAY * emb, mean.T @ dz, dz.sum(0)), state, (RATE * pace, RATE, RATE), strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x -= rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.99**step)) + 1e-10)
    out = np.zeros(BUCKETS, np.float32)
    out[names] = (soft[:, 1] - soft[:, 0]) @ emb * GAIN
    return Model(out, float(bias[1] - bias[0]))


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, most: dict[int, int]) -> list[tuple[str, int]]:
    """At most `most[label]` texts of each label outside fold 0, in an order fixed by a hash of the id.

    Of rows that repeat a doc_id, the one with the least text is learnt from.
    """
    known = labels.where(F.col(label).isin(0, 1) & (common.fold(folds) != 0)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    key = (F.xxhash64("doc_id"), "doc_id")
    some = known.where("label = 1").orderBy(*key).limit(most[1]).unionByName(known.where("label = 0").orderBy(*key).limit(most[0]))
    found = docs.select("doc_id", common.whole_text().alias("text")).join(F.broadcast(some), "doc_id")
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()  # as many rows as `most` says
    return [(r["text"], r["label"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, most: dict[int, int] = SAMPLE) -> Model:
    """A model from the labelled documents outside fold 0."""
    rows = sample_labelled(docs, labels, "toxic", folds, most)
    return train([t for t, _ in rows], np.array([y for _, y in rows], np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every document, by its whole text."""
    common.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.whole_text(text_col).alias("text"))
    shared = source.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, {}
        for batch in batches:
            split = [_WORDS.findall(t.lower()) for t in batch.column("text").to_pylist()]
            distinct = set().union(*split)
            if len(table) + len(distinct) > TABLE_ROWS:
                table = {}
            long = {w: words_in(w) for w in distinct if len(w) > LONG}
            new = [w for w in distinct if w not in table and w not in long]
            if new:
                subs = [buckets_of(w) for w in new]
                n = np.array([len(s) for s in subs])
                table |= zip(new, (np.add.reduceat(m.weight[[b for s in subs for b in s]], _segments(n)) / n).tolist(), strict=True)
            table |= {w: n * m.word(w) for w, n in long.items()}
            more = [sum(long.get(w, 1) - 1 for w in ws) for ws in split] if long else [0] * len(split)
            z = np.array([sum(map(table.__getitem__, ws)) / max(LEAST_WORDS, len(ws) + k) + m.bias for ws, k in zip(split, more, strict=True)])
            for w in long:
                del table[w]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))})

    return source.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())]))
