"""Octree searches give the grid joins' rows, and measure fewer pairs of a clustered cloud."""

import numpy as np
import pytest

from pointmill.operators import octree, spatial


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(9)
    xyz = np.vstack([rng.normal(0, 0.01, (250, 3)), rng.random((150, 3)) * 20, np.full((40, 3), 3.0)])
    rows = [(k, *map(float, p)) for k, p in enumerate(xyz)] + [(5000, None, 1.0, 1.0)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double").cache()


def told(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_radius_equals_the_grid(cloud):
    tree = octree.build(cloud, 16, 1e-4)
    for r in (0.3, 4.0):
        want = told(spatial.radius_join(cloud, cloud, r), "qid", "nid", "dist")
        assert told(octree.radius(cloud, tree, r), "qid", "nid", "dist") == want
    pairs = octree.candidates(cloud, tree, 0.3)
    measured = pairs.where("not whole").count()
    assert measured < 0.1 * spatial.candidates(cloud, cloud, 0.3).count() and pairs.where("whole and sq > 0.09").isEmpty()


@pytest.mark.parametrize("k", [1, 7, 60])
def test_nearest_equal_brute_force(cloud, k):
    q = cloud.where("pid % 7 = 0").withColumn("x", cloud["x"] + 0.001)
    tree = octree.build(cloud, 16, 1e-4)
    want = told(spatial.knn_brute(q, cloud.where("x is not null"), k).where("dist is not null"), "qid", "nid", "dist", "rank")
    assert told(octree.knn(q, tree, k), "qid", "nid", "dist", "rank") == want


def test_small_and_empty_clouds(spark, cloud):
    three = cloud.limit(3)
    assert octree.knn(three, octree.build(three), 5).count() == 9
    none = octree.build(cloud.where("false"))
    assert octree.knn(three, none, 2).collect() == [] == octree.radius(three, none, 1.0).collect()
