"""Descriptors and samples against plain numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointmill.operators import features, filters


def shot_by_hand(p, n, r, slots=11):
    """Quadrilinear signature of every point, in plain loops."""
    out = {}
    for i in range(len(p)):
        d = p - p[i]
        dist = np.sqrt((d**2).sum(1))
        near = np.flatnonzero((dist <= r) & (np.arange(len(p)) != i))
        if near.size < 3:
            continue
        d, dist, m = d[near], dist[near], n[near]
        w = r - dist
        vec = np.linalg.eigh((d * w[:, None]).T @ d / w.sum())[1]

        def towards(v, d=d):
            s = np.sign(d @ v).sum() or (d @ v).sum()
            return -v if s < 0 else v

        z, x = towards(vec[:, 0]), towards(vec[:, 2])
        y, h = np.cross(z, x), np.zeros((8, 2, 2, slots))
        for q, e, b in zip(d, dist, m, strict=True):
            at = [(np.arctan2(q @ y, q @ x) + np.pi) / (2 * np.pi) * 8, np.arcsin(np.clip(q @ z / e, -1, 1)) / np.pi * 2 + 1, e / r * 2, (np.clip(b @ z, -1, 1) + 1) / 2 * slots]
            for corner in range(16):
                share, place = 1.0, []
                for k, (c, size) in enumerate(zip(at, h.shape, strict=True)):
                    low = int(np.floor(c - 0.5))
                    up = corner >> k & 1
                    share *= (c - 0.5 - low) if up else 1 - (c - 0.5 - low)
                    place.append((low + up) % size if k == 0 else min(size - 1, max(0, low + up)))
                h[tuple(place)] += share
        out[i] = h.ravel() / np.sqrt((h**2).sum())
    return out


def test_shot_equals_numpy_and_survives_rotation(spark):
    rng = np.random.default_rng(6)
    p = rng.random((500, 3)) * [1.0, 1.0, 0.5]
    n = rng.standard_normal((500, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    a, b = 0.7, -1.1
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) @ np.array([[1, 0, 0], [0, np.cos(b), -np.sin(b)], [0, np.sin(b), np.cos(b)]])

    def told(p, n):
        rows = [(k, *map(float, (*u, *v))) for k, (u, v) in enumerate(zip(p, n, strict=True))]
        df = spark.createDataFrame(rows, "pid long, x double, y double, z double, nx double, ny double, nz double")
        return {r["pid"]: np.array(r["vec"]) for r in features.shot(df, 0.25).collect()}

    got, want, turned = told(p, n), shot_by_hand(p, n, 0.25), told(p @ turn.T, n @ turn.T)
    assert len(want) > 450 and all(len(v) == 352 for v in got.values())
    assert max(np.abs(got[i] - want[i]).max() for i in want) < 1e-6
    assert max(np.abs(got[i] - turned[i]).max() for i in want) < 1e-6


def test_shot_without_a_frame(spark):
    line = [(k, 0.1 * k, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(5)] + [(9, 50.0, 0.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(line, "pid long, x double, y double, z double, nx double, ny double, nz double")
    got = features.shot(df, 0.25).collect()
    assert sorted(r["pid"] for r in got) == [0, 1, 2, 3, 4] and all(r["vec"] == [0.0] * 352 for r in got)


def test_farthest_points_in_rounds_equal_one_group(spark):
    rng = np.random.default_rng(7)
    xyz = np.vstack([rng.random((900, 3)), np.round(rng.random((300, 3)), 1), np.zeros((40, 3))])
    rows = pd.DataFrame({"frame": np.repeat([1, 2, 3], [600, 600, 40]), "pid": rng.permutation(1240), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    df = spark.createDataFrame(rows)
    want = sorted(map(tuple, filters.fps(df, 60, ("frame",)).collect()))
    assert want == sorted(map(tuple, filters.fps(df, 60, ("frame",), rows=0, candidates=16).collect()))
    assert want == sorted(map(tuple, filters.fps(df, 60, ("frame",), rows=500).collect()))
    assert filters.fps(df.where(F.lit(False)), 5, ("frame",), rows=0).collect() == []
