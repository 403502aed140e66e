"""Closed forms, brute force and invariants of the point operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointmill.functions.graph import connected_components
from pointmill.operators import boxes, cluster, evaluate, filters, ground, linalg, registration, spatial
from pointmill.sources import formats


def cloud(spark, rows):
    return spark.createDataFrame([(i, 0, *map(float, r)) for i, r in enumerate(rows)], "pid long, frame int, x double, y double, z double")


@pytest.fixture(scope="module")
def random_cloud(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(0, 2, (300, 3))
    return p, cloud(spark, p.tolist()).cache()


def test_grid_joins_equal_brute_force(random_cloud):
    p, df = random_cloud
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    near = {(r["qid"], r["nid"]) for r in spatial.radius_join(df, df, 0.8).collect()}
    assert near == {(i, j) for i, j in zip(*np.nonzero(d <= 0.8), strict=True)}
    knn = spatial.knn_join(df, df, 5).collect()
    want = {(i, int(j), k + 1) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    assert {(r["qid"], r["nid"], r["rank"]) for r in knn} == want


def test_knn_is_radius_at_its_last_distance(random_cloud):
    _, df = random_cloud
    far = max(r["dist"] for r in spatial.knn_join(df.where("pid = 7"), df, 6).collect())
    assert spatial.radius_join(df.where("pid = 7"), df, far * (1 + 1e-12)).count() == 6


def test_radius_border_is_closed_unless_strict(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0)])
    assert spatial.radius_join(df, df, 1.0).count() == 4
    assert spatial.radius_join(df, df, 1.0, strict=True).count() == 2


def test_identical_points(spark):
    df = cloud(spark, [(1, 1, 1)] * 50)
    assert spatial.kd_partition(df, 8).select("node").distinct().count() == 1
    assert [r["nid"] for r in spatial.knn_brute(df.where("pid = 9"), df, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert spatial.octree_cells(df, 8, 1e-3).count() == 50


def test_fewer_points_than_k(spark):
    df = cloud(spark, [(0, 0, 0), (5, 0, 0)])
    assert spatial.knn_join(df, df, 8).count() == 4


def test_kd_leaves_hold_at_most_leaf_points(random_cloud):
    _, df = random_cloud
    sizes = [r["count"] for r in spatial.kd_partition(df, 20).groupBy("node").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 20


def test_ranks_of_one_crowded_key(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 5 else None, int(v), i) for i, v in enumerate(rng.permutation(500))]
    got = spatial.ranked(spark.createDataFrame(rows, "k string, v long, i long").repartition(6), ["v"], ["k"]).collect()
    for key in ("a", None):
        want = sorted(v for k, v, _ in rows if k == key)
        assert [r["v"] for r in sorted((r for r in got if r["k"] == key), key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in got if r["k"] == "a") == list(range(1, 401))


def test_vector_blocks_equal_one_block(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(0, 1, (60, 9)).tolist())], "pid long, vec array<double>")
    told = lambda block: sorted((r["qid"], r["rank"], r["nid"]) for r in spatial.knn_vectors(df, df, 3, block=block).collect())
    assert told(7) == told(1000)


def test_plane_and_cube(spark):
    rng = np.random.default_rng(1)
    flat = np.column_stack([rng.uniform(-5, 5, (60, 2)), np.zeros(60)])
    row = linalg.plane_fit(cloud(spark, flat.tolist())).first()
    assert abs(abs(row["nz"]) - 1) < 1e-9 and abs(row["d"]) < 1e-9
    cube = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    s = linalg.stats(cloud(spark, cube)).first()
    assert np.allclose([s["cxx"], s["cyy"], s["czz"], s["cxy"]], [2, 2, 2, 0])


def test_eigenvalues_equal_numpy_and_survive_rotation(spark, random_cloud):
    p, df = random_cloud
    got = linalg.pca(df).first()
    want = np.sort(np.linalg.eigvalsh((p - p.mean(0)).T @ (p - p.mean(0))))[::-1]
    assert np.allclose([got["l1"], got["l2"], got["l3"]], want)
    a = 0.3
    turned = linalg.pca(registration.moved(df, np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]), np.ones(3))).first()
    assert np.allclose([turned["l1"], turned["l2"], turned["l3"]], want)


def test_ground_of_a_plane_with_a_block(spark):
    rows = [(x, y, -1.7) for x in range(-10, 10) for y in range(-10, 10)] + [(2 + i / 10, 3, -1.7 + 0.3 + j / 10) for i in range(3) for j in range(3)]
    out = ground.svd(cloud(spark, rows).withColumn("seg", F.lit(0)), thr=0.1).toPandas()
    assert out.is_ground.sum() == 400 and not out[out.pid >= 400].is_ground.any()


def test_kmeans_on_six_points(spark):
    rows = [(1, 2), (1.5, 1.8), (5, 8), (8, 8), (1, 0.6), (9, 11)]
    df = spark.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(rows)], "pid long, x double, y double")
    got, _ = cluster.kmeans(df, 2, cols=("x", "y"))
    label = {r["pid"]: r["k"] for r in got.collect()}
    assert label[1] == label[2] == label[5] != label[3] == label[4] == label[6]


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_dbscan_labels_do_not_depend_on_order(random_cloud):
    _, df = random_cloud
    a = {r["pid"]: r["cluster"] for r in cluster.dbscan(df, 0.9, 5).collect()}
    b = {r["pid"]: r["cluster"] for r in cluster.dbscan(df.repartition(7), 0.9, 5).collect()}
    assert a == b and set(a.values()) - {-1}


def test_fps_starts_low_and_spreads(spark):
    df = cloud(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (4, 0, 0)])
    assert [r["pid"] for r in filters.fps(df, 3, ("frame",)).orderBy("step").collect()] == [0, 2, 3]


def test_icp_finds_a_known_motion(random_cloud):
    _, df = random_cloud
    a = math.radians(4)
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    got, t, errors = registration.icp(df, registration.moved(df, r, np.array([0.05, -0.02, 0.01])).cache(), max_iter=12)
    assert np.allclose(got, r, atol=1e-3) and errors[-1] < errors[0]


def test_iou_of_shifted_squares(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 0.5, 0.0, 1.5, 1.0)], "a_x1 double, a_y1 double, a_x2 double, a_y2 double, b_x1 double, b_y1 double, b_x2 double, b_y2 double")
    assert abs(df.select(boxes.iou_2d("a_", "b_").alias("i")).first()["i"] - 1 / 3) < 1e-12


def clipped_area(p, q):
    """Overlap of two convex polygons by cutting one with the lines of the other."""
    for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in p]
        out = []
        for i, (x, y) in enumerate(p):
            j = (i + 1) % len(p)
            if side[i] >= 0:
                out.append((x, y))
            if side[i] * side[j] < 0:
                t = side[i] / (side[i] - side[j])
                out.append((x + t * (p[j][0] - x), y + t * (p[j][1] - y)))
        p = out
        if len(p) < 3:
            return 0.0
    return abs(sum(x * p[(i + 1) % len(p)][1] - y * p[(i + 1) % len(p)][0] for i, (x, y) in enumerate(p))) / 2


def test_ground_overlap_equals_clipping(spark):
    rng = np.random.default_rng(4)
    box = lambda: (*rng.uniform(-1.5, 1.5, 2), *rng.uniform(0.5, 4, 2), rng.uniform(-4, 4))
    rows = [(box(), box()) for _ in range(200)]
    # the same box, shared edges, corners on edges, one inside the other, apart, no area
    unit = (0.0, 0.0, 2.0, 2.0, 0.0)
    rows += [(b, b) for b, _ in rows[:20]] + [(unit, (1.0, 0.0, 2.0, 2.0, 0.0)), (unit, (2.0, 0.0, 2.0, 2.0, 0.0)), (unit, (0.0, 0.0, 2.0, 2.0, math.pi / 4)), (unit, (0.0, 0.0, 1.0, 1.0, 0.3)), (unit, (9.0, 0.0, 2.0, 2.0, 0.3)), (unit, (0.0, 0.0, 0.0, 2.0, 0.0)), (unit, (0.0, 0.0, 2.0, 2.0, math.pi / 2))]

    def corners(t1, t3, length, width, ry):
        c, s = math.cos(ry), math.sin(ry)
        return [(c * x + s * y + t1, c * y - s * x + t3) for x, y in ((length / 2, width / 2), (-length / 2, width / 2), (-length / 2, -width / 2), (length / 2, -width / 2))]

    flat = [(k, *map(float, p), *map(float, q), 1.5, 1.5, 1.7, 1.9) for k, (p, q) in enumerate(rows)]
    names = [f"{side}_{n}" for side in "ab" for n in ("t1", "t3", "l", "w", "ry")] + ["a_h", "b_h", "a_t2", "b_t2"]
    df = spark.createDataFrame(flat, "k int, " + ", ".join(f"{n} double" for n in names))
    got = boxes.ground_overlaps(df).withColumn("iou", boxes.ground_ratio("bev")).orderBy("k").collect()
    want = [clipped_area(corners(*p), corners(*q)) if min(p[2], p[3], q[2], q[3]) > 0 else 0.0 for p, q in rows]
    assert np.allclose([r["_flat"] for r in got], want, atol=1e-6)
    assert np.allclose([r["_solid"] for r in got], np.array(want) * 1.3, atol=1e-6)
    assert all(abs(r["iou"] - 1) < 1e-6 for r in got[200:220])


def test_contending_detections():
    gt = [(0, 0, False, 0.0), (1, 0, False, 0.0)]
    det = [(0, 0, 0.9, 0.0), (1, 0, 0.8, 0.0), (2, 1, 0.95, 0.0)]  # the last one is too low
    over = {(d, g): o for d, g, o in [(0, 0, 0.8), (1, 0, 0.9), (2, 0, 0.95), (0, 1, 0.85), (1, 1, 0.75), (2, 1, 0.8)]}
    scores = evaluate.match_frame(gt, det, over, {}, 0.7, None)
    assert scores["fn"] == 0 and scores["tp"] == 1 and scores["scores"] == [0.9]
    counted = evaluate.match_frame(gt, det, over, {}, 0.7, 0.0)
    assert (counted["tp"], counted["fp"], counted["fn"]) == (2, 0, 0)
    assert evaluate.match_frame(gt, det, over, {}, 0.7, 0.85)["tp"] == 1


def test_thresholds_equal_the_walk(spark):
    rng = np.random.default_rng(4)
    scores = sorted(rng.uniform(0, 1, 700).tolist(), reverse=True)
    df = spark.createDataFrame([("Car", 0, 900, scores)], "cls string, difficulty int, n_gt long, scores array<double>")
    assert [r["thresh"] for r in evaluate.thresholds(df).orderBy("rank").collect()] == evaluate.recall_thresholds(scores, 900)


def test_ply_round_trip():
    text = b"ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n"
    assert formats.parse_ply(text).to_numpy().tolist() == [[1, 2, 3], [4, 5, 6]]


def test_truncated_records_and_short_labels(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.arange(8, dtype="<f4").tobytes() + b"\0\0\0")
    assert formats.read_velodyne(spark, str(tmp_path / "a.bin")).count() == 2
    row = "Car 0 0 1 0 0 10 50 1 1 1 0 0 0 0"
    (tmp_path / "000007.txt").write_text(f"{row}\nCar 1\n{row}\n")
    got = formats.read_labels(spark, str(tmp_path / "000007.txt")).collect()
    assert len(got) == 1 and got[0]["frame"] == "000007"


def test_frames_stream(spark, tmp_path):
    from pointmill.streaming import frames

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "f0.bin").write_bytes(np.zeros(8, "<f4").tobytes())
    seen = []
    q = frames.each_frame(frames.watch_bins(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, i: seen.append(df.count()))
    q.awaitTermination(60)
    assert sum(seen) == 1


def test_empty_tables(spark):
    empty = cloud(spark, [(0, 0, 0)]).where("false")
    assert spatial.radius_join(empty, empty, 1.0).count() == 0
    assert filters.voxel(empty, 1.0).count() == 0
    assert cluster.dbscan(empty, 1.0, 2).count() == 0
    assert filters.segment_uniform(empty, 3).count() == 0
    assert isinstance(linalg.stats(empty, ("frame",)).toPandas(), pd.DataFrame)
