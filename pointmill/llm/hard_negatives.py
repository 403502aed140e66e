"""Hard negatives from embeddings by product quantisation with stored residual norms.

1. Codebooks are fitted on a bounded sample (`SAMPLE` rows in the order of a hash). Every row is then
   indexed: its whole-number vector, its codes, and the norm of its residual in each subspace, in blocks of a written table.
2. Anchors in blocks meet all row blocks on numbered lanes. For a pair of blocks, lookup tables give each anchor's score with
   each row's code; the score with the row itself lies within the residual bound (Cauchy-Schwarz in each subspace). Rows whose
   bounds can't reach the anchor's best are dropped; the rest are scored exactly in integers. A pair of blocks hands on a
   few rows for each anchor, and Spark ranks those of all blocks.
3. The same with each positive's window of scores: the bounds tell rows that may be in it, integers decide.

The bounds only save work: results equal a scan of all pairs, whatever the codebooks. Cost: anchors times rows.

Rows with a null id, label or vector, or with null or non-finite entries take no part; a shorter vector is read
as if zeros followed. Ties go by the smaller id; rows that repeat an id are rows of their own (ties among
them by their number in the index) and an anchor that is repeated gives its rows as often. Many equal vectors tie in one block
of bounded size. A score beyond 64 bits raises. An empty table, or one without anchors, gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.tables import written
from pointmill.llm import common, vectors

#: Rows that the codebooks are fitted on, and rounds of the fit.
SAMPLE, ROUNDS = 8192, 8
#: Entries of a subspace and codes of a codebook.
WIDTH, CODES = 2, 256
#: Rows of a block, anchors of a block, anchors scored at a time, and most lanes.
BLOCK, ANCHORS, STEP, LANES = 16_384, 1024, 64, 20_000

_INDEX = "block long, n int, kind string, ids binary, labels binary, x binary, codes binary, residuals binary"


def codebooks(sample: np.ndarray, width: int = WIDTH, codes: int = CODES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook of at most `codes` centres for each `width` entries, by Lloyd's rounds over the sample."""
    out = []
    for k in range(0, sample.shape[1], width):
        part = sample[:, k : k + width]
        centres = np.unique(part, axis=0)
        centres = centres[np.linspace(0, len(centres) - 1, min(codes, len(centres))).astype(int)] if len(centres) else np.zeros((1, part.shape[1]))
        for _ in range(rounds if len(part) else 0):
            near = nearest(part, centres)
            size = np.bincount(near, minlength=len(centres))
            sums = np.stack([np.bincount(near, part[:, c], len(centres)) for c in range(part.shape[1])], 1)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        out.append(centres)
    return out


def nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * part @ centres.T).argmin(1)


def index(rows: DataFrame, books: list[np.ndarray], d: int, block: int = BLOCK) -> DataFrame:
    """The written index of (id, label, vec) rows: blocks of ids, labels, vectors, codes and residual norms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 20, [], 0

        def out() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            kind = next(k for k in ("int16", "int32", "int64") if np.iinfo(k).min <= int(x.min(initial=0)) and int(x.max(initial=0)) <= np.iinfo(k).max)
            codes, residuals = np.zeros((len(books), len(x)), np.uint8), np.zeros((len(books), len(x)), np.float32)
            for k, book in enumerate(books):
                part = x[:, k * WIDTH : (k + 1) * WIDTH].astype(float)
                codes[k] = nearest(part, book)
                residuals[k] = np.sqrt(((part - book[codes[k]]) ** 2).sum(1)) * (1 + 1e-6)  # not below its value in 32 bits
            data = {"ids": ids.tobytes(), "labels": labels.tobytes(), "x": x.astype(kind).tobytes(), "codes": codes.tobytes(), "residuals": residuals.tobytes()}
            return pa.RecordBatch.from_pydict({"block": pa.array([number]), "n": pa.array([len(x)], pa.int32()), "kind": [kind], **{c: pa.array([v], pa.binary()) for c, v in data.items()}})

        for batch in batches:
            for k in range(0, batch.num_rows, block):  # no more than a block and a half is held
                part = batch.slice(k, block)
                ok, found = vectors.matrix(part.column("vec"), d)
                if ok.any():
                    held.append((*(np.array(part.column(c))[ok] for c in ("id", "label")), vectors.whole_numbers(found)))
                    size += int(ok.sum())
                if size >= block:
                    yield out()
                    number, held, size = number + 1, [], 0
        if held:
            yield out()

    return written(rows.mapInArrow(run, _INDEX), "pq_index")


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of rows with one vector; raises where 64 bits don't hold one."""
    if x.size and int(np.abs(x.astype(float)).max()) * int(np.abs(y.astype(float)).max()) * y.size >= 2**62:
        return np.array([sum(int(a) * int(b) for a, b in zip(r, y, strict=True)) for r in x.tolist()], object).astype(np.int64)
    return x.astype(np.int64) @ y


class Bounds:
    """Lookup-table scores of some anchors with the rows of a block, and how far the true ones may be off."""

    def __init__(self, row: dict, books: list[np.ndarray], d: int) -> None:
        n = row["n"]
        self.books, self.d = books, d
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["x"], row["kind"]).reshape(n, d)
        self.codes, self.residuals = np.frombuffer(row["codes"], np.uint8).reshape(-1, n), np.frombuffer(row["residuals"], np.float32).reshape(-1, n)
        self.longest = float(np.sqrt((self.x.astype(float) ** 2).sum(1)).max(initial=0))

    def of(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, a row for each anchor."""
        a = anchors.astype(float)
        score, norms = np.zeros((len(self.x), len(a)), np.float32), np.zeros((len(a), len(self.books)), np.float32)
        for k, book in enumerate(self.books):
            part = a[:, k * WIDTH : (k + 1) * WIDTH]
            score += (book @ part.T).astype(np.float32)[self.codes[k]]  # the lookup: a row of scores for each code
            norms[:, k] = np.sqrt((part**2).sum(1))
        off = norms @ self.residuals
        off += (1e-4 * self.longest * np.sqrt((a**2).sum(1)) + 1).astype(np.float32)[:, None]  # 32-bit rounding
        return score.T - off, score.T + off


def top(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by falling score, then id, then row."""
    return np.lexsort((rows, ids, -score))[:k]


def _packed_anchors(anchors: DataFrame, lanes: int, d: int) -> DataFrame:
    """Blocks of anchors (ar, id, label, x, scores), each sent to every lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(k, ANCHORS)
                yield pa.RecordBatch.from_pydict({**{f"a_{c}": pa.array([np.array(part.column(c), np.int64).tobytes()], pa.binary()) for c in ("ar", "label")}, "a_x": pa.array([np.array(part.column("x").flatten(), np.int64).tobytes()], pa.binary()), "a_scores": pa.array([part.column("scores").to_pylist()], pa.list_(pa.list_(pa.int64())))})

    told = anchors.select("ar", "label", "x", "scores").mapInArrow(run, "a_ar binary, a_label binary, a_x binary, a_scores array<array<long>>")
    return told.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))


def _meet(blocks: DataFrame, anchors: DataFrame, lanes: int, books: list[np.ndarray], d: int, pick) -> DataFrame:
    """What `pick` takes from every pair of an anchor and a row block: (ar, positive, score, id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = Bounds(row, books, d)
                number = (row["block"] << 16) + np.arange(row["n"])
                ar, labels = np.frombuffer(row["a_ar"], np.int64), np.frombuffer(row["a_label"], np.int64)
                x = np.frombuffer(row["a_x"], np.int64).reshape(len(ar), d)
                found = []
                for k in range(0, len(ar), STEP):
                    low, high = held.of(x[k : k + STEP])
                    for i in range(len(low)):
                        found += [(ar[k + i], p, s, held.ids[at], number[at]) for p, s, at in pick(held, number, ar[k + i], labels[k + i], x[k + i], row["a_scores"][k + i], low[i], high[i])]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found, strict=True)], names=["ar", "p", "score", "id", "row"])

    joined = blocks.repartition(lanes, "lane").join(anchors.repartition(lanes, "lane"), "lane").drop("lane")
    return joined.mapInArrow(run, "ar long, p long, score long, id long, row long")


def mine(df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    An anchor's positives are its first other rows of the same label; the negatives of each are the first rows of other
    labels whose score is `low` to `high` hundredths of the positive's.
    """
    common.small_batches(df.sparkSession)
    rows = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    d = vectors.dimension(rows, "vec")
    some = [r["vec"] for r in rows.where(F.col("vec").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()]  # SAMPLE rows
    ok, sample = vectors.matrix(pa.array(some, pa.list_(pa.float64())), d)
    books = codebooks(vectors.whole_numbers(sample).astype(float))
    blocks = index(rows.select("id", "label", "vec"), books, d)
    lanes = max(1, min(LANES, blocks.count()))
    blocks = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes).cast("long")).cast("int"))

    marked = rows.where("anchor").select(F.col("id").alias("aid")).distinct()
    chosen = _unpacked(blocks, d).join(marked, F.col("id") == F.col("aid"), "left_semi")
    chosen = written(chosen, "anchors")

    def pick_positives(held, number, ar, label, x, _, low_, high_):
        at = np.flatnonzero((held.labels == label) & (number != ar))
        if at.size > positives:
            at = at[high_[at] >= np.partition(low_[at], -positives)[-positives]]
        score = exact(held.x[at], x)
        return [(0, score[k], at[k]) for k in top(score, held.ids[at], number[at], positives)]

    found = _meet(blocks, _packed_anchors(chosen.withColumn("scores", F.array().cast("array<long>")), lanes, d), lanes, books, d, pick_positives)
    order = Window.partitionBy("ar").orderBy(F.desc("score"), "id", "row")
    best = written(found.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives), "positives")
    scores = best.groupBy("ar").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "score"))), lambda s: s["score"]).alias("scores"))  # `positives` at most

    def pick_negatives(held, number, ar, label, x, scores_, low_, high_):
        windows = [(p, -(-low * s // 100), high * s // 100) for p, s in enumerate(scores_, 1) if -(-low * s // 100) <= high * s // 100]
        if not windows:
            return []
        every = np.flatnonzero((held.labels != label) & (high_ >= min(w[1] for w in windows)) & (low_ <= max(w[2] for w in windows)))
        out, lows, highs = [], low_[every], high_[every]
        for p, least, most in windows:
            maybe = (highs >= least) & (lows <= most)
            sure = lows[(lows >= least) & (highs <= most)]
            if sure.size >= negatives:
                maybe &= highs >= np.partition(sure, -negatives)[-negatives]
            at = every[maybe]
            score = exact(held.x[at], x)
            inside = (score >= least) & (score <= most)
            at, score = at[inside], score[inside]
            out += [(p, score[k], at[k]) for k in top(score, held.ids[at], number[at], negatives)]
        return out

    told = _meet(blocks, _packed_anchors(chosen.join(scores, "ar"), lanes, d), lanes, books, d, pick_negatives)
    order = Window.partitionBy("ar", "p").orderBy(F.desc("score"), "id", "row")
    told = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("ar", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.select("ar", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return told.join(named, ["ar", "p"]).join(chosen.select("ar", F.col("id").alias("anchor_id")), "ar").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _unpacked(blocks: DataFrame, d: int) -> DataFrame:
    """(ar, id, label, x) of every row of the index; `ar` is its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], row["kind"]).reshape(row["n"], d).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((row["block"] << 16) + np.arange(row["n"])), pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(np.frombuffer(row["labels"], np.int64)), vectors.list_column(x)], names=["ar", "id", "label", "x"])

    return blocks.select("block", "n", "kind", "ids", "labels", "x").mapInArrow(run, "ar long, id long, label long, x array<long>")
