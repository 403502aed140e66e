"""Drawn seeds, mini-batches and binned mean shift against plain Python."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.operators import centres


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.normal(c, 0.5, (60, 3)) for c in (0, 4, 8)] + [np.full((20, 3), 2.0)])
    rows = [(k * 3, *map(float, p)) for k, p in enumerate(xyz)]
    return spark.createDataFrame([*rows, (9999, None, 0.0, 0.0)], "pid long, x double, y double, z double").cache(), rows


def test_shares_of_draws_follow_the_weights(spark):
    """4,000 draws among six rows by the operator's own key: each share within three standard deviations."""
    d = [0.1, 0.5, 1.0, 1.5, 2.0, 2.5]
    mean = sum(d) / len(d)
    rows = spark.range(4000).select(F.col("id").alias("seed"), F.explode(F.array(*[F.struct(F.lit(k).alias("pid"), F.lit(v).alias("d")) for k, v in enumerate(d)])).alias("r")).select("seed", "r.*")
    key = centres.draw_key(F.col("d"), F.lit(mean), centres.uniform(F.col("seed"), F.lit(1), F.col("pid")))
    got = rows.withColumn("key", key).where("key is not null").groupBy("seed").agg(F.min_by("pid", "key").alias("pid")).groupBy("pid").count().collect()
    weights = {k: math.exp(v) for k, v in enumerate(d) if v >= mean}
    assert {r["pid"] for r in got} == set(weights)
    for r in got:
        p = weights[r["pid"]] / sum(weights.values())
        assert abs(r["count"] / 4000 - p) < 3 * math.sqrt(p * (1 - p) / 4000)


def test_drawn_seeds_of_small_tables(cloud):
    df, rows = cloud
    found = centres.seed_drawn(df, 4, 1)
    assert len(set(found)) == 4 and set(found) <= {r[1:] for r in rows} and found == centres.seed_drawn(df.repartition(5), 4, 1)
    assert centres.seed_drawn(df.where("false"), 3) == []
    one = df.where("pid = 0")
    assert centres.seed_drawn(one, 2) == [rows[0][1:]] * 2


def test_same_batches_give_the_same_centres(cloud):
    df, rows = cloud
    start = [(1.0, 1.0, 1.0), (5.0, 5.0, 5.0), (6.0, 6.0, 6.0), (900.0, 0.0, 0.0)]
    want, counts = [np.array(p) for p in start], [0] * 4
    for _ in range(3):
        for b in range(5):
            mine = [np.array(r[1:]) for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == b]
            near = [int(np.argmin([((p - c) ** 2).sum() for c in want])) for p in mine]
            for k in sorted(set(near)):
                new = [p for p, n in zip(mine, near, strict=True) if n == k]
                want[k] = (want[k] * counts[k] + sum(new)) / (counts[k] + len(new))
                counts[k] += len(new)
    labels, got = centres.minibatch_kmeans(df, start, 5, passes=3, tol=None)
    assert np.allclose(got, want, atol=1e-9) and got[3] == start[3]
    assert {r["pid"]: r["k"] for r in labels.collect()} == {r[0]: int(np.argmin([((np.array(r[1:]) - c) ** 2).sum() for c in want])) for r in rows}
    with pytest.raises(RuntimeError):
        centres.minibatch_kmeans(df, start, 5, passes=1, tol=1e-12)


def shift_by_hand(x, bandwidth):
    seeds = sorted({tuple(np.rint(p / bandwidth)) for p in x})
    modes = {}
    for s in seeds:
        at = np.array(s) * bandwidth
        for _ in range(300):
            near = x[((x - at) ** 2).sum(1) <= bandwidth**2]
            if not len(near):
                break
            new = near.mean(0)
            moved, at = np.sqrt(((new - at) ** 2).sum()), new
            if moved <= 1e-3 * bandwidth:
                modes[tuple(np.round(at, 9))] = len(near)
                break
    kept = []
    for p, n in sorted(modes.items(), key=lambda m: (m[1], m[0]), reverse=True):
        if all(((np.array(p) - np.array(q)) ** 2).sum() > bandwidth**2 for q, _ in kept):
            kept.append((p, n))
    return kept


def test_binned_mean_shift_equals_plain_python(cloud):
    df, rows = cloud
    x = np.array([r[1:] for r in rows])
    want = shift_by_hand(x, 1.2)
    labels, modes = centres.mean_shift_seeded(df, 1.2)
    got = modes.orderBy("cluster").collect()
    assert [r["n"] for r in got] == [n for _, n in want] and np.allclose([[r["x"], r["y"], r["z"]] for r in got], [p for p, _ in want], atol=1e-8)
    near = {r[0]: int(np.argmin([((p - np.array(m)) ** 2).sum() for m, _ in want])) for r, p in zip(rows, x, strict=True)}
    assert {r["pid"]: r["cluster"] for r in labels.collect()} == near
    with pytest.raises(RuntimeError):
        centres.mean_shift_seeded(df, 1.2, max_iter=1)


def test_bandwidth_is_a_mean_of_neighbour_distances(cloud):
    df, rows = cloud
    x = np.array([r[1:] for r in rows])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 1)
    assert math.isclose(centres.estimate_bandwidth(df, 0.3), d[:, int(0.3 * len(x)) - 1].mean(), rel_tol=1e-9)
    assert centres.estimate_bandwidth(df.where("false")) == 0.0
