"""Augmentation of objects: every draw comes from a hash of the object's id and a seed, so it can be repeated."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ
from pointmill.operators.spatial import ranked

NORMALS = ("nx", "ny", "nz")


def uniform(id: Column, seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number in [low, high) fixed by an integer id and a seed."""
    u = F.pmod(id * 7919 + seed * 104729 + 12345, F.lit(1000003)) / 1000003.0
    return low + u * (high - low)


def normal(id: Column, seed: int, sigma: float, clip: float) -> Column:
    """A clipped Gaussian number fixed by an integer id and a seed (two uniforms, Box and Muller)."""
    a, b = uniform(id, 2 * seed + 1, 1e-6, 1.0), uniform(id * 31 + 17, 2 * seed + 2)
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), sigma * F.sqrt(-2 * F.ln(a)) * F.cos(2 * math.pi * b)))


def rotated(df: DataFrame, angle: Column, axis: str = "z", cols: Sequence[str] = XYZ) -> DataFrame:
    """Row vectors times the rotation matrix about an axis."""
    x, y, z = (F.col(c) for c in cols)
    c, s = F.cos(angle), F.sin(angle)
    new = {"y": (c * x - s * z, y, s * x + c * z), "z": (c * x - s * y, s * x + c * y, z), "x": (x, c * y - s * z, s * y + c * z)}[axis]
    return df.select(*[new[cols.index(k)].alias(k) if k in cols else F.col(k) for k in df.columns])


def rotate(df: DataFrame, key: str, seed: int = 1, axis: str = "y", normals: bool = False) -> DataFrame:
    """Each object turned about the axis by its own angle; its normals too if asked."""
    angle = uniform(F.col(key), seed, 0, 2 * math.pi)
    out = rotated(df, angle, axis)
    return rotated(out, angle, axis, NORMALS) if normals else out


def rotate_by(df: DataFrame, angle: float, axis: str = "y", normals: bool = False) -> DataFrame:
    out = rotated(df, F.lit(angle), axis)
    return rotated(out, F.lit(angle), axis, NORMALS) if normals else out


def perturb(df: DataFrame, key: str, seed: int = 1, sigma: float = 0.06, clip: float = 0.18, normals: bool = False) -> DataFrame:
    """Three small clipped Gaussian turns of each object, about x, then y, then z."""
    out = df
    for i, axis in enumerate("xyz"):
        angle = normal(F.col(key), seed + i, sigma, clip)
        out = rotated(out, angle, axis)
        if normals:
            out = rotated(out, angle, axis, NORMALS)
    return out


def jitter(df: DataFrame, id: str = "pid", seed: int = 1, sigma: float = 0.01, clip: float = 0.05) -> DataFrame:
    """Clipped Gaussian noise on every coordinate."""
    return df.select(*[(F.col(c) + normal(F.col(id), seed + 10 * XYZ.index(c), sigma, clip)).alias(c) if c in XYZ else F.col(c) for c in df.columns])


def shift(df: DataFrame, key: str, seed: int = 1, reach: float = 0.1) -> DataFrame:
    return df.select(*[(F.col(c) + uniform(F.col(key), seed + XYZ.index(c), -reach, reach)).alias(c) if c in XYZ else F.col(c) for c in df.columns])


def scale(df: DataFrame, key: str, seed: int = 1, low: float = 0.8, high: float = 1.25) -> DataFrame:
    return df.select(*[(F.col(c) * uniform(F.col(key), seed, low, high)).alias(c) if c in XYZ else F.col(c) for c in df.columns])


def dropout(df: DataFrame, key: str, id: str = "pid", seed: int = 1, most: float = 0.875) -> DataFrame:
    """A share of each object's points (up to `most`) become its first point."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*XYZ), id).alias("_f"))
    gone = uniform(F.col(id), seed + 100) <= uniform(F.col(key), seed, 0, most)
    j = df.join(first, key)
    return j.select(*[F.when(gone, F.col(f"_f.{c}")).otherwise(F.col(c)).alias(c) if c in XYZ else F.col(c) for c in df.columns])


def local_z(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """Each object turned about the vertical through its centroid."""
    mean = df.groupBy(key).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    angle = uniform(F.col(key), seed, 0, 2 * math.pi)
    c, s = F.cos(angle), F.sin(angle)
    j = df.join(mean, key)
    dx, dy = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my")
    new = {"x": c * dx - s * dy + F.col("_mx"), "y": s * dx + c * dy + F.col("_my")}
    return j.select(*[new[k].alias(k) if k in new else F.col(k) for k in df.columns])


def shuffled_samples(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    """(key, pos): the objects in a fixed random order."""
    draw = F.pmod(F.col(key) * 7919 + seed, F.lit(1000003))
    return ranked(df.select(key).distinct().withColumn("_draw", draw), ["_draw", key]).select(key, F.col("pos").cast("int").alias("pos"))


def shuffled_points(df: DataFrame, key: str, id: str = "pid", seed: int = 1) -> DataFrame:
    """Adds slot: one permutation of the places, shared by all objects."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(id)) - 1
    put = df.withColumn("_i", place)
    return put.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy(F.pmod(F.col("_i") * 7919 + seed, F.lit(1000003)), "_i")) - 1).drop("_i")


#: Combinations of rotation, drop-out, shift and jitter by class: they rebalance the rare ones.
COMBOS = {"Cyclist": ("r", "rd", "rj", "rs", "rsj", "rsd", "rsjd"), "Pedestrian": ("r", "rsjd")}


def offline(df: DataFrame, kind: str = "type", key: str = "obj", id: str = "pid", seed: int = 1) -> DataFrame:
    """The rows and, for rare classes, their augmented copies; `combo` says which ('' for the original)."""
    out = df.withColumn("combo", F.lit(""))
    for combo in sorted({c for v in COMBOS.values() for c in v}):
        some = df.where(F.col(kind).isin([k for k, v in COMBOS.items() if combo in v]))
        if "r" in combo:
            some = local_z(some, key, seed)
        if "s" in combo:
            some = shift(some, key, seed)
        if "j" in combo:
            some = jitter(some, id, seed)
        if "d" in combo:
            some = dropout(some, key, id, seed)
        out = out.unionByName(some.withColumn("combo", F.lit(combo)))
    return out
