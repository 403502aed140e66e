"""The data side of point networks: sampling, grouping and pooling."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ
from pointmill.operators import filters, spatial

def sample_and_group(df: DataFrame, n: int, r: float, nsample: int, key: Sequence[str], id: str = "pid") -> DataFrame:
    """(key.., centre, slot, nid, dx, dy, dz): farthest-point centres and the coordinates of their balls about them."""
    centres = filters.fps(df, n, key, id).select(*key, id).join(df.select(*key, id, *XYZ), [*key, id])
    ball = spatial.ball_query(centres, df, r, nsample, key, id, id)
    c = centres.select(*key, F.col(id).alias("qid"), *[F.col(a).alias(f"_c{a}") for a in XYZ])
    p = df.select(*key, F.col(id).alias("nid"), *XYZ)
    return ball.join(c, [*key, "qid"]).join(p, [*key, "nid"]).select(*key, F.col("qid").alias("centre"), "slot", "nid", *[(F.col(a) - F.col(f"_c{a}")).alias(f"d{a}") for a in XYZ])


def whole_group(df: DataFrame, key: Sequence[str], id: str = "pid") -> DataFrame:
    """(key.., slot, nid, dx, dy, dz): all points of an object as one group about the origin, a row each."""
    slot = F.row_number().over(Window.partitionBy(*key).orderBy(id)) - 1
    return df.select(*key, slot.alias("slot"), F.col(id).alias("nid"), *[F.col(c).alias(f"d{c}") for c in XYZ])


def group_all(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Size and greatest coordinates of an object, its points being one group about the origin."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in XYZ])


def weights(inputs: int, outputs: int, seed: int) -> list[list[float]]:
    return (np.random.default_rng(seed).normal(0, 1 / math.sqrt(inputs), (outputs, inputs))).round(6).tolist()


def shared_mlp(df: DataFrame, inputs: Sequence[str], layers: Sequence[Sequence[Sequence[float]]], out: str = "f") -> tuple[DataFrame, list[str]]:
    """Dense layers with ReLU over columns, the same for every row; returns the frame and the new columns' names."""
    now = list(inputs)
    for depth, layer in enumerate(layers):
        new = [F.greatest(F.lit(0.0), sum((F.col(c) * float(w) for c, w in zip(now, row, strict=True)), F.lit(0.0))).alias(f"{out}{depth}_{i}") for i, row in enumerate(layer)]
        df = df.select("*", *new)
        now = [f"{out}{depth}_{i}" for i in range(len(layer))]
    return df, now


def set_abstraction(df: DataFrame, n: int, r: float, nsample: int, layers, key: Sequence[str], id: str = "pid") -> DataFrame:
    """(key.., centre, f..): shared layers over each ball, then the greatest of each feature."""
    grouped, names = shared_mlp(sample_and_group(df, n, r, nsample, key, id), ("dx", "dy", "dz"), layers)
    return grouped.groupBy(*key, "centre").agg(*[F.max(c).alias(c) for c in names])


def set_abstraction_msg(df: DataFrame, n: int, radii: Sequence[float], nsamples: Sequence[int], layers, key: Sequence[str], id: str = "pid") -> DataFrame:
    """set_abstraction at several radii, features side by side."""
    out = None
    for i, (r, s) in enumerate(zip(radii, nsamples, strict=True)):
        one = set_abstraction(df, n, r, s, layers, key, id)
        one = one.select(*key, "centre", *[F.col(c).alias(f"s{i}_{c}") for c in one.columns if c not in (*key, "centre")])
        out = one if out is None else out.join(one, [*key, "centre"])
    return out


def feature_propagation(dense: DataFrame, coarse: DataFrame, values: Sequence[str], skip: Sequence[str] = (), id: str = "pid", key: Sequence[str] = ()) -> DataFrame:
    """Coarse features at the dense points by three neighbours, beside the dense ones."""
    found = spatial.interpolate(dense, coarse, values, 3, id, id, key)
    return found.withColumnRenamed("qid", id).join(dense.select(*key, id, *skip), [*key, id])
