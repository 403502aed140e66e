"""Points in boxes of very different sizes."""

import numpy as np

from pointmill.operators import boxes


def test_wide_boxes_cost_the_others_nothing(spark):
    rng = np.random.default_rng(5)
    xyz = rng.uniform(-300, 300, (2500, 3)) * [1, 0.003, 1]
    sizes = [(500.0, 3.0, 2.0)] + [(4.0, 1.8, 1.6)] * 300 + [(0.0, 0.0, 0.0), (0.3, 40.0, 1.0)]
    made = [(1 + k % 2, k, *map(float, rng.uniform(-250, 250, 1)), 0.5, float(rng.uniform(-250, 250)), h, w, s, float(rng.uniform(-3, 3))) for k, (s, w, h) in enumerate(sizes)]
    p = spark.createDataFrame([(1 + k % 2, k, *map(float, v)) for k, v in enumerate(xyz)], "frame int, pid long, x double, y double, z double")
    b = spark.createDataFrame(made, "frame int, ord long, t1 double, t2 double, t3 double, h double, w double, l double, ry double")
    want = set()
    for f, o, t1, t2, t3, h, w, s, ry in made:
        c, n = np.cos(ry), np.sin(ry)
        d = xyz - [t1, t2, t3]
        along, across = c * d[:, 0] - n * d[:, 2], n * d[:, 0] + c * d[:, 2]
        inside = (np.abs(along) <= s * 1.15 / 2) & (np.abs(across) <= w * 1.25 / 2) & (d[:, 1] <= 0) & (d[:, 1] >= -h)
        want |= {(f, int(k), o) for k in np.flatnonzero(inside) if 1 + k % 2 == f}
    got = boxes.points_in(p, b)
    assert {(r["frame"], r["pid"], r["box"]) for r in got.collect()} == want and len(want) > 5
    assert boxes.points_in(p, b.where("false")).collect() == []


def test_overlaps_in_blocks_are_those_of_all_pairs(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)

    def made(n):
        x, y = rng.uniform(0, 80, n), rng.uniform(0, 40, n)
        d = np.stack([x, y, x + rng.uniform(-1, 40, n), y + rng.uniform(0, 30, n), rng.uniform(0, 20, n), rng.uniform(1, 2, n), rng.uniform(0, 15, n), rng.uniform(1, 2, n), rng.uniform(-0.1, 2, n), rng.uniform(0, 5, n), rng.uniform(-4, 4, n)], 1)
        d[: n // 10, 4:] = d[n // 10 : 2 * (n // 10), 4:]  # the same place twice
        rows = [(int(k % 3), k, *map(float, v)) for k, v in enumerate(d)] + [(1, n, *[None] * 11), (None, n + 1, *map(float, d[0]))]
        return spark.createDataFrame(rows, "frame int, ord long, " + ", ".join(f"{c} double" for c in ("x1", "y1", "x2", "y2", "t1", "t2", "t3", "h", "w", "l", "ry")))

    monkeypatch.setattr(boxes, "PART", 40)  # several parts of a frame
    a, b = made(300), made(260)
    for metric, cols, shared in (("image", boxes.IMAGE, None), ("bev", boxes.GROUND, "_flat"), ("3d", boxes.GROUND, "_solid")):
        pairs = boxes.match_pairs(a.dropna(), b.dropna(), ("ord", *cols))
        of = (lambda c: boxes.iou_2d("a_", "b_", c)) if shared is None else (lambda c, m=metric: boxes.ground_ratio(m, c))
        told = (pairs if shared is None else boxes.ground_overlaps(pairs)).select("frame", F.col("a_ord").alias("det"), F.col("b_ord").alias("gt"), of(-1).alias("overlap"), of(0).alias("first"), of(1).alias("second")).where("first > 0")
        key = lambda df: {(r["frame"], r["det"], r["gt"]): (r["overlap"], r["first"], r["second"]) for r in df.collect()}
        got, want = key(boxes.overlapping(a, b, metric)), key(told)
        assert got.keys() == want.keys() and len(want) > 300
        assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)
        assert boxes.overlapping(a.where("false"), b, metric).collect() == [] == boxes.overlapping(a, b.where("false"), metric).collect()
