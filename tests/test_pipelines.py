"""The whole pipelines against plain numpy: ground, clusters, rules, labelled boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.plans import pipelines, views

SEGMENTS = [(-150, -20), (-20, 20), (20, 150)]


@pytest.fixture(scope="module")
def cloud(spark, sf_dir):
    """The larger table: the smallest one has too few points over the ground."""
    p = views.scan(spark, sf_dir.replace("sf0.001", "sf0.01")).where("frame < 2").cache()
    return p, p.orderBy("pid").toPandas()


def over_ground(pts, lpr=10_000, thr=0.18, below=-1.23):
    """Which rows of one segment are no ground after six rounds of plane fits."""
    low = pts[pts[:, 2] < below]
    if not len(low):
        return None  # no seeds, no plane: the segment has no rows
    chosen = low[low[:, 2] < np.sort(low[:, 2])[:lpr].mean() + thr]
    for _ in range(6):
        if len(chosen) < 3:
            return np.ones(len(pts), bool)
        mean = chosen.mean(0)
        normal = np.linalg.eigh((chosen - mean).T @ (chosen - mean))[1][:, 0]
        ground = np.abs((pts - mean) @ normal) < thr
        chosen = pts[ground]
    return ~ground


def density_clusters(ids, xyz, eps, least):
    """{id: cluster} of density clusters, named by their least core id."""
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    name = np.where(core, ids, np.iinfo(np.int64).max)
    while True:
        new = np.array([min([name[i], *name[near[i] & core]]) if core[i] else name[i] for i in range(len(ids))])
        if (new == name).all():
            break
        name = new
    out = {int(i): int(n) for i, n, c in zip(ids, name, core, strict=True) if c}
    for i in np.flatnonzero(~core):
        around = [int(n) for n in name[near[i] & core]]
        if around:
            out[int(ids[i])] = min(around)
    return out


def front_of(rows, **how):
    """The rows of one frame that are over the ground of their segment."""
    parts = []
    for low, high in SEGMENTS:
        part = rows[(rows["x"] > low) & (rows["x"] < high)]
        keep = over_ground(part[["x", "y", "z"]].to_numpy(), **how) if len(part) else None
        if keep is not None:
            parts.append(part[keep])
    return parts


def test_foreground_objects(cloud):
    points, rows = cloud
    want = {}
    for frame, mine in rows.groupby("frame"):
        mine = mine[(mine["y"] > -15) & (mine["y"] < 30)]
        front = np.concatenate([p[["pid", "x", "y", "z"]].to_numpy() for p in front_of(mine)])
        ids, xyz = front[:, 0].astype(np.int64), front[:, 1:]
        labels = density_clusters(ids, xyz, 8.0, 3)
        for c in set(labels.values()):
            at = xyz[[k for k, i in enumerate(ids) if labels.get(int(i)) == c]]
            low, high = at.min(0), at.max(0)
            tall = high[2] - low[2]
            want[frame, c] = (3 if low[2] + 1.73 > 0.5 or tall < 1.0 or tall > 2.3 else 0, len(at), *np.round([*low, *high], 6))
    got = {(r["frame"], r["cluster"]): (r["verdict"], r["n"], *np.round([r[f"{m}{c}"] for m in ("min", "max") for c in "xyz"], 6)) for r in pipelines.foreground_objects(points, eps=8.0, min_points=3).collect()}
    assert got == want and len(want) > 3


def test_dataset_of_labelled_objects(spark, cloud, sf_dir):
    points, rows = cloud
    labels = views.with_3d(views.gt_boxes(spark, sf_dir.replace("sf0.001", "sf0.01"))).where("type <> 'DontCare' and frame < 2").withColumn("t2", F.lit(0.5)).withColumn("h", F.lit(3.0)).cache()
    want = set()
    for frame, mine in rows.groupby("frame"):
        xyz, inside = mine[["x", "y", "z"]].to_numpy(), np.zeros(len(mine), bool)
        for b in labels.where(F.col("frame") == int(frame)).collect():
            d, c, s = xyz - [b["t1"], b["t2"], b["t3"]], np.cos(b["ry"]), np.sin(b["ry"])
            along, across = c * d[:, 0] - s * d[:, 2], s * d[:, 0] + c * d[:, 2]
            hit = (np.abs(along) <= b["l"] * 1.15 / 2) & (np.abs(across) <= b["w"] * 1.25 / 2) & (d[:, 1] <= 0) & (d[:, 1] >= -b["h"])
            inside |= hit
            want |= {(frame, b["ord"], b["type"], int(i)) for i in mine["pid"][hit]}
        rest = front_of(mine[~inside])
        front = np.concatenate([p[["pid", "x", "y", "z"]].to_numpy() for p in rest])
        found = density_clusters(front[:, 0].astype(np.int64), front[:, 1:], 3.0, 4)
        sizes = {c: list(found.values()).count(c) for c in set(found.values())}
        want |= {(frame, c, "DontCare", i) for i, c in found.items() if sizes[c] > 4 and c % 8 == 0}
    got = {(r["frame"], r["obj"], r["cls"], r["pid"]) for r in pipelines.build_objects(points, labels).collect()}
    assert got == want and {c for _, _, c, _ in want} >= {"Car"}
