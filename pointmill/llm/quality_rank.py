"""Quality by Bradley-Terry ranking: scores whose differences explain which of two documents is preferred.

Every pair of a good and a bad labelled document counts: a logistic loss on the differences of their text features
fits one weight for each feature. A pair's loss depends on the difference of two scores only, so rows meet by bins of
the score: a bin holds sums over its rows, a Taylor series about the bins' centres gives the gradient over all pairs,
and a Newton step is one pass over a written table of features. Its start is fitted to a bounded sample, which changes
the number of steps only: the loss has one minimum. The cut is the quantile of all labelled rows' scores at the share of
bad documents, found by counts in ever finer bins; the returned score is a logistic curve through 0.3 at the cut.
Features are a Python helper over Arrow batches, so every row is scored in one pass without a shuffle.

Nulls: a null text is empty; the empty text has a score like any other. Null labels are not learnt from.
Repeated rows each get a row, equal texts equal scores; very long texts are read whole. Of rows that repeat a doc_id the
one with the least features is learnt from. An empty table gives no rows. Only id, text and the label are read.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.tables import written
from pointmill.llm import common

#: Labelled rows of each class that the first weights are fitted to; the steps after them read all rows.
SAMPLE_OF_CLASS = 3000
#: Preference pairs for each bad document of that sample.
PAIRS_EACH = 20
#: The returned score at the cut.
CUT = 0.3
#: Pull of the weights towards zero.
RIDGE = 1e-3
#: Bins of the score: scores 50 apart make bins of 0.05, and the series then leaves out less than 1e-8 of a pair's share.
BINS = 1024
#: Highest power in the series.
ORDER = 4
#: Newton steps at most; weights are fitted to STEP and rounded, so that the order of sums doesn't show.
ROUNDS, STEP, DECIMALS = 40, 1e-8, 9

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
FEATURES = ("symbols", "bars", "shouts", "capitals", "digits", "stops", "lines", "word_chars", "distinct", "few_words")


#: Names of inner columns that documents won't have.
_TEXT, _FEATURES = "_pointmill_text", "_pointmill_features"

#: Second bytes of the capitals that UTF-8 writes as 0xC3 and another byte.
_SECOND = np.zeros(256, bool)
_SECOND[[c.encode()[1] for c in _UPPER if not c.isascii()]] = True
_BYTES = np.arange(256)
_INDEX = {name: np.isin(_BYTES, list(chars)) for name, chars in {"symbols": b"#*$%&<>", "bars": b"|", "shouts": b"!", "capitals": _UPPER.encode()[:26], "digits": b"0123456789", "stops": b".?,;:", "lines": b"\n", "blanks": b" \t\n\r"}.items()}


def features_of(text: bytes) -> list[float]:
    """Ratios of one text that saturate, so that no text is far outside the others."""
    a = np.frombuffer(text, np.uint8)
    counts = np.bincount(a, minlength=256)
    n_bytes = {name: int(counts[places].sum()) for name, places in _INDEX.items()}
    all_chars = a.size - int(counts[0x80:0xC0].sum())
    capitals = n_bytes["capitals"] + (int(_SECOND[a[1:][a[:-1] == 0xC3]].sum()) if counts[0xC3] else 0)
    words = text.split()  # at 0x20 and 0x09 to 0x0D
    n, n_chars = max(len(words), 1), max(all_chars, 1)
    return [
        min(n_bytes["symbols"] * 5.0 / n, 1.0),
        min(n_bytes["bars"] * 5.0 / n, 1.0),
        min(n_bytes["shouts"] * 2.0 / n, 1.0),
        min(capitals * 2.0 / n_chars, 1.0),
        min(n_bytes["digits"] * 5.0 / n_chars, 1.0),
        min(n_bytes["stops"] * 2.0 / n, 1.0),
        min(n_bytes["lines"] * 4.0 / n, 1.0),
        min((all_chars - n_bytes["blanks"]) / n / 20.0, 1.0),
        # distinct words against what length allows
        min(len(set(words)) / n**0.75, 1.0),
        min(20.0 / n, 1.0),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(text: pa.Array) -> pa.Array:
    found = [x for t in text.cast(pa.binary()).to_pylist() for x in features_of(t)]
    return common.list_array([len(FEATURES)] * len(text), pa.array(found, pa.float64()))


def with_features(docs: DataFrame, text_col: str = "text", name: str = "features") -> DataFrame:
    """The frame with a column of features of a text that is not null."""
    common.small_batches(docs.sparkSession)
    return docs.withColumn(name, _features(text_col))


@dataclass
class Ranking:
    """Weights of the features and the cut."""

    weights: list[float]
    cut: float

    def strength(self, name: str = "features") -> Column:
        """The weighted sum of a column of features."""
        return sum((F.element_at(name, i + 1) * F.lit(w) for i, w in enumerate(self.weights)), F.lit(0.0))

    def column(self, name: str = "features") -> Column:
        """The score, 0 to 1, from a column of features."""
        return 1.0 / (1.0 + F.exp(-(self.strength(name) - F.lit(self.cut) + F.lit(float(np.log(CUT / (1 - CUT)))))))


def fit_pairs(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE, seed: int = 7) -> Ranking:
    """Newton steps on the logistic loss of feature differences of random good-bad pairs."""
    best, worst = x[good == 1], x[good == 0]
    if not len(best) or not len(worst):
        return Ranking([0.0] * x.shape[1], -10.0 if not len(worst) else 0.0)
    rng = np.random.default_rng(seed)
    d = best[rng.integers(0, len(best), PAIRS_EACH * len(worst))] - np.repeat(worst, PAIRS_EACH, 0)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(d.shape[1])
        step = np.linalg.solve(h, d.T @ (1 - p) / len(d) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Ranking(w.tolist(), 0.0)


def bins_of(weights: np.ndarray) -> tuple[float, float]:
    """Where the bins begin and how wide they are: features are 0 to 1, so no score is outside."""
    low, high = float(np.minimum(weights, 0).sum()), float(np.maximum(weights, 0).sum())
    return low, max(high - low, 1e-6) / BINS


def bin_sums(x: np.ndarray, good: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums for each label and bin: of t**m and t**m * x for each m to ORDER, t the score's distance from the bin's centre, and of x * x."""
    d = x.shape[1]
    out = np.zeros((2, BINS, (ORDER + 1) * (d + 1) + d * d))
    if not len(x):
        return out
    low, width = bins_of(weights)
    s = x @ weights
    k = np.clip(((s - low) / width).astype(np.int64), 0, BINS - 1)
    t = s - (low + (k + 0.5) * width)
    one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    row = np.concatenate([*(one * (t**m)[:, None] for m in range(ORDER + 1)), (x[:, :, None] * x[:, None, :]).reshape(len(x), d * d)], axis=1)
    at = good.astype(np.int64) * BINS + k
    order = np.argsort(at, kind="stable")
    places, runs = common.runs_of(at[order])
    out.reshape(2 * BINS, -1)[places] = np.add.reduceat(row[order], [a for a, _ in runs], axis=0)
    return out


def slope(sums: np.ndarray, weights: np.ndarray, ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the mean loss over all good-bad pairs from their bins' sums, and its curvature."""
    d = weights.size
    low, width = bins_of(weights)
    centre = low + (np.arange(BINS) + 0.5) * width
    powers = sums[:, :, : (ORDER + 1) * (d + 1)].reshape(2, BINS, ORDER + 1, d + 1)
    squares = sums[:, :, (ORDER + 1) * (d + 1) :].reshape(2, BINS, d, d)
    pairs = powers[0, :, 0, 0].sum() * powers[1, :, 0, 0].sum()
    # p: how surely the good one wins; lost and its derivatives by the difference of scores
    p = 1 / (1 + np.exp(-(centre[:, None] - centre[None, :])))
    v = p * (1 - p)
    lost = [1 - p, -v, -v * (1 - 2 * p), -v * (1 - 6 * v), -v * (1 - 2 * p) * (1 - 12 * v)]
    pull = np.zeros(d)
    for a in range(ORDER + 1):
        for b in range(ORDER + 1 - a):
            share = lost[a + b] * ((-1) ** b / math.factorial(a) / math.factorial(b))
            good, bad = powers[1, :, a], powers[0, :, b]
            pull += good[:, 1:].T @ (share @ bad[:, 0]) - bad[:, 1:].T @ (share.T @ good[:, 0])
    good, bad = powers[1, :, 0], powers[0, :, 0]
    cross = good[:, 1:].T @ v @ bad[:, 1:]
    curve = np.tensordot(v @ bad[:, 0], squares[1], 1) + np.tensordot(v.T @ good[:, 0], squares[0], 1) - cross - cross.T
    return -pull / pairs + ridge * weights, curve / pairs + ridge * np.eye(d)


def fit_all(rows: DataFrame, start: np.ndarray) -> np.ndarray:
    """The weights of least loss over all good-bad pairs of a written table of (label, features), which has both labels."""

    def sums_at(weights: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = bin_sums(np.empty((0, weights.size)), np.empty(0), weights)
            for batch in batches:
                x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += bin_sums(x, batch.column("label").to_numpy(zero_copy_only=False), weights) if len(x) else 0
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        # a deep tree, so that the driver gets a handful of sums however many tasks there are
        parts = rows.select("label", "features").mapInArrow(run, "sums binary")
        return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(np.add, depth=4).reshape(2, BINS, -1)

    weights, best = start, None
    for _ in range(ROUNDS):
        gradient, curve = slope(sums_at(weights), weights)
        if best is not None and np.abs(gradient).max() > best[1]:
            weights = (weights + best[0]) / 2  # the step went too far
            continue
        best = weights, np.abs(gradient).max()
        step = np.linalg.solve(curve, gradient)
        weights = weights - step
        if np.abs(step).max() < STEP:
            return weights
    warnings.warn(f"weights of the ranking still moved after {ROUNDS} rounds", stacklevel=2)
    return best[0]


def with_cut(ranking: Ranking, rows: DataFrame, n_below: int) -> Ranking:
    """The cut just below the score of the row that has `n_below` others before it; of equal scores, all are above it.

    Counts in bins of the score, then in bins of the bin that holds the row, until that has one score only.
    """
    scores = rows.select(ranking.strength().alias("s"))
    low, high, n = scores.agg(F.min("s"), F.max("s"), F.count("s")).first()
    if not 0 < n_below < n:
        return ranking
    before, under = n_below, None  # rows still to pass, the highest score under the interval
    while low < high:
        place = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * F.lit(float(BINS))), F.lit(BINS - 1))
        inside = scores.where((F.col("s") >= F.lit(low)) & (F.col("s") <= F.lit(high)))
        for b in sorted(inside.groupBy(place.alias("k")).agg(F.count("s").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()):
            if before < b["n"]:
                low, high = b["low"], b["high"]
                break
            before, under = before - b["n"], b["high"]
    return Ranking(ranking.weights, low if under is None else (under + low) / 2)


def labelled(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, label, features) of all labelled documents outside fold 0, as a written table."""
    mine = F.col("doc_id").isNotNull() & (common.fold(folds) != 0)
    known = labels.where(F.col("quality").isin(0, 1) & mine).select("doc_id", F.col("quality").cast("int").alias("label")).distinct()
    # features first: rows of ten numbers meet the labels, not the texts
    found = with_features(docs.where(mine).select("doc_id", common.whole_text().alias("text"))).select("doc_id", "features")
    return written(found.join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")), "quality_rows")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, per_class: int = SAMPLE_OF_CLASS) -> Ranking:
    """A ranking from all labelled documents outside fold 0; its steps start from weights fitted to at most `per_class` of each label."""
    rows = labelled(docs, labels, folds)
    key = (F.xxhash64("doc_id"), "doc_id")
    few = rows.where("label = 1").orderBy(*key).limit(per_class).unionByName(rows.where("label = 0").orderBy(*key).limit(per_class)).collect()
    few.sort(key=lambda r: (r["doc_id"], r["label"]))
    y = np.array([r["label"] for r in few], int)
    start = fit_pairs(np.array([r["features"] for r in few], float).reshape(len(few), len(FEATURES)), y)
    if not 0 < y.sum() < y.size:
        return start  # at most one of the labels occurs
    weights = fit_all(rows, np.array(start.weights))
    return with_cut(Ranking(weights.round(DECIMALS).tolist(), 0.0), rows, rows.where("label = 0").count())


def score(docs: DataFrame, ranking: Ranking, name: str = "score") -> DataFrame:
    """All columns of the documents and the score, under a name that they don't have."""
    with_text = docs.withColumn(_TEXT, common.whole_text())
    return with_features(with_text, _TEXT, _FEATURES).withColumn(name, ranking.column(_FEATURES)).drop(_TEXT, _FEATURES)


def accepted(docs: DataFrame, ranking: Ranking, cut: float = CUT) -> DataFrame:
    """The documents whose score is at least the cut, all columns kept."""
    kept = "_pointmill_score"
    return score(docs, ranking, kept).where(F.col(kept) >= cut).drop(kept)
