"""Whitening of embeddings with an exact covariance.

Vectors become whole numbers x. Each distinct x counts once: n of them with sums S. Every task splits
n * x - S into limbs of 20 bits, so that the products of limb matrices over a block of rows are whole numbers
that float64 holds exactly; the sums of all tasks are recombined as big integers. Only then is anything rounded:
the covariance is divided by n^3, and its eigenvectors project the rows.

Rows whose vector is null or has null or non-finite entries are left out; a shorter vector is read as if
zeros followed, an empty one as zeros. Nulls and repeats of the id don't matter: rows go by themselves. Repeated vectors
count once in the fit, whatever share of the table they are. Components without variance (fewer distinct vectors than components, or all
vectors in a plane) have a null `whitened`; equal eigenvalues come in the order of the solver. An empty table gives no rows. Further
columns are not read.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointmill.functions.tables import written
from pointmill.llm import vectors

#: Bits of a limb, and rows of a block: sums of products stay under 2 ** (2 * LIMB) * BLOCK = 2 ** 52.
LIMB, BLOCK = 20, 1 << 12
#: Blocks whose sums 64-bit numbers hold with room to spare.
BLOCKS = 128


@dataclass
class Whitening:
    """n, S and the largest |n * x - S| of the fit list; unit components as rows, their eigenvalues and the trace."""

    n: int
    sums: list[int]
    most: int
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def varies(self) -> np.ndarray:
        """Which components have variance beyond the solver's rounding."""
        return self.eigenvalues > len(self.sums) * 2.3e-16 * max(self.trace, 0.0)


def integers(df: DataFrame, vec: str, keep: tuple[str, ...] = (), scale: int = vectors.SCALE) -> DataFrame:
    """The `keep` columns and x, floor(scale * c) of each entry, of the rows whose vector is valid."""
    d = vectors.dimension(df, vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, found = vectors.matrix(batch.column("x"), d)
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in keep), vectors.list_column(vectors.whole_numbers(found, scale))], names=[*keep, "x"])

    source = df.select(*keep, F.col(vec).alias("x"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("x", T.ArrayType(T.LongType()))]))


def _rows(column: pa.ListArray, d: int) -> np.ndarray:
    return np.array(column.flatten(), np.int64).reshape(len(column), d)


def centred(x: np.ndarray, n: int, sums: list[int], most: int) -> np.ndarray:
    """n * x - S, as Python's integers where 64 bits are too few."""
    kind = np.int64 if most < 2**62 and n * (int(np.abs(x).max()) if x.size else 0) < 2**62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def limbs(y: np.ndarray, count: int) -> list[np.ndarray]:
    """Matrices of doubles below 2 ** LIMB in size, lowest first, with y = sum of limb k * 2 ** (LIMB * k)."""
    size, sign = np.abs(y), np.where(y < 0, -1.0, 1.0)
    return [((size >> (LIMB * k)) & ((1 << LIMB) - 1)).astype(float) * sign for k in range(count)]


def moments(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """n, S and the largest |n * x - S|; a row for each dimension comes from each task."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        least, most = np.full(d, 2**63 - 1), np.full(d, -(2**63))
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch.column("x"), d)
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
                least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"k": pa.array(np.arange(d)), "n": pa.array([n] * d), "high": pa.array(high), "low": pa.array(low), "least": pa.array(least), "most": pa.array(most)})

    told = fit.mapInArrow(tell, "k long, n long, high long, low long, least long, most long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = told.groupBy("k").agg(F.sum("n").alias("n"), total("high"), total("low"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row a dimension
    rows = {r["k"]: r for r in rows}
    n = rows[0]["n"] if rows else 0
    sums = [(int(rows[k]["high"]) << 32) + int(rows[k]["low"]) for k in range(d)] if rows else [0] * d
    return n, sums, max([0, *(abs(n * v - s) for k, s in enumerate(sums) if rows for v in (rows[k]["least"], rows[k]["most"]))])


def products(fit: DataFrame, n: int, sums: list[int], most: int) -> list[list[int]]:
    """Sums over the fit list of (n * x - S) times its transpose, exact."""
    d, count = len(sums), max(1, -(-most.bit_length() // LIMB))
    i, j = np.triu_indices(d)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks = np.zeros((2 * count - 1, d, d), np.int64), 0

        def out() -> pa.RecordBatch:
            flat = held[:, i, j]
            return pa.RecordBatch.from_pydict({"power": pa.array(np.repeat(np.arange(len(held)), i.size)), "i": pa.array(np.tile(i, len(held))), "j": pa.array(np.tile(j, len(held))), "value": pa.array(flat.ravel())})

        for batch in batches:
            x = _rows(batch.column("x"), d)
            for k in range(0, len(x), BLOCK):
                parts = limbs(centred(x[k : k + BLOCK], n, sums, most), count)
                for a in range(count):
                    held[2 * a] += (parts[a].T @ parts[a]).astype(np.int64)
                    for b in range(a):
                        cross = (parts[a].T @ parts[b]).astype(np.int64)
                        held[a + b] += cross + cross.T
                blocks += 1
                if blocks == BLOCKS:
                    yield out()
                    held[:], blocks = 0, 0
        if blocks:
            yield out()

    told = fit.mapInArrow(multiply, "power long, i long, j long, value long").groupBy("power", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    whole = [[0] * d for _ in range(d)]
    for r in told.collect():  # d * (d + 1) / 2 numbers for each power
        whole[r["i"]][r["j"]] += int(r["value"]) << (LIMB * r["power"])
    for a in range(d):
        for b in range(a):
            whole[a][b] = whole[b][a]
    return whole


def fit(distinct: DataFrame, components: int = 4) -> Whitening:
    """The components of greatest variance of a written table of distinct x."""
    d = int(distinct.select(F.size("x")).first()[0]) if not distinct.isEmpty() else 0
    n, sums, most = moments(distinct, d)
    whole = products(distinct, n, sums, most) if n and d else []
    cov = np.array([[v / n**3 for v in row] for row in whole]).reshape(d, d)  # true division of integers rounds once
    values, found = np.linalg.eigh(cov)
    top = np.argsort(-values, kind="stable")[:components]
    found = found[:, top].T
    signs = [-1.0 if v[np.abs(v).argmax()] < 0 else 1.0 for v in found]
    return Whitening(n, sums, most, found * np.array(signs).reshape(-1, 1), values[top], sum(whole[k][k] for k in range(d)) / max(n, 1) ** 3)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """Rows of integers() with `deviation`, the exact sum of (n * x - S)^2, and `whitened`, an array by component."""
    d, names = len(model.sums), [c for c in rows.columns if c != "x"]
    scale = np.where(model.varies(), np.sqrt(np.maximum(model.eigenvalues, 1e-300)), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with decimal.localcontext() as rule:
            rule.prec = 100
            for batch in batches:
                y = centred(_rows(batch.column("x"), d), model.n, model.sums, model.most)
                square = (y if d * model.most**2 < 2**63 else y.astype(object)) ** 2
                told = (y / model.n).astype(float) @ model.components.T / scale if model.n else np.zeros((len(y), 0))
                value = vectors.list_column(told)
                value = pa.ListArray.from_arrays(value.offsets, pa.array(told.ravel(), from_pandas=True))  # nan: null
                exact = pa.array([decimal.Decimal(int(v)) for v in square.sum(1)], pa.decimal128(38))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), exact, value], names=[*names, "deviation", "whitened"])

    kept = [rows.schema[c] for c in names]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))]))


def identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured; None without variance."""
    able = np.flatnonzero(model.varies()).tolist()
    if not able:
        return None
    told = transform(distinct, model).select(*[F.get("whitened", k).alias(f"w{k}") for k in able])
    row = told.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a in able for b in able if a <= b]).first()  # centred by Spark before multiplying
    return max(abs(row[f"c{a}_{b}"] - (a == b)) for a in able for b in able if a <= b)


def whiten(df: DataFrame, components: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, Whitening, float | None]:
    """(id, deviation, whitened) of every valid row, the fitted components, and the identity error."""
    rows = integers(df, vec_col, (id_col,))
    distinct = written(rows.select("x").distinct(), "fit")
    model = fit(distinct, components)
    return transform(rows, model), model, identity_error(distinct, model)
