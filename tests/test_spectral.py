"""Spectral clustering: the iteration over the edge table gives the dense way's clusters."""

import numpy as np

from pointmill.operators import cluster, spectral
from pointmill.plans import views


def parts(rows):
    out = {}
    for r in rows:
        out.setdefault((r[0], r["cluster"]), set()).add(r["pid"])
    return {(k[0], frozenset(v)) for k, v in out.items()}


def frame_of(spark, clouds):
    rows = [(f * 100_000 + k, f, *map(float, p)) for f, cloud in enumerate(clouds) for k, p in enumerate(cloud)]
    return spark.createDataFrame(rows, "pid long, frame int, x double, y double, z double").cache()


def clouds(rng, n):
    turn = lambda m: 2 * np.pi * np.arange(m) / m
    ring = lambda r, m: np.stack([r * np.cos(turn(m)), r * np.sin(turn(m)), rng.normal(0, 0.02, m)], 1)
    return [np.vstack([ring(1, n), ring(3, 2 * n)]), np.vstack([rng.normal(0, 0.3, (n, 3)), rng.normal(0, 0.3, (n, 3)) + [9, 0, 0], rng.normal(0, 0.3, (n, 3)) + [0, 9, 0]]), rng.normal(0, 1, (n, 3))]


def test_iteration_equals_the_dense_way(spark, sf_dir):
    df = frame_of(spark, [*clouds(np.random.default_rng(1), 60), np.zeros((1, 3)), np.zeros((12, 3))])
    dense, iterated = (cluster.spectral(df, ("frame",), dense=n).collect() for n in (spectral.DENSE, 0))
    assert parts(dense) == parts(iterated)
    some = df.where("frame < 3")
    assert parts(cluster.spectral(some, ("frame",), block=0).collect()) == {p for p in parts(dense) if p[0] < 3}
    assert {f: len({r["cluster"] for r in dense if r["frame"] == f}) for f in range(5)} == {0: 2, 1: 3, 2: 1, 3: 1, 4: 1}
    assert sorted(r["pid"] for r in dense) == sorted(r["pid"] for r in df.collect())
    p = views.pts3(spark, sf_dir)
    assert parts(cluster.spectral(p, ("frame",)).collect()) == parts(cluster.spectral(p, ("frame",), dense=0).collect())


def test_values_and_vectors_equal_numpy():
    rng = np.random.default_rng(2)
    w = rng.random((40, 40)) * (rng.random((40, 40)) < 0.2)
    w += w.T + np.eye(40)
    p = w / w.sum(1, keepdims=True)
    v, t = rng.standard_normal((40, 4)), []
    for k in range(40):
        t.append(v if k == 0 else p @ v if k == 1 else 2 * p @ t[-1] - t[-2])
    e = np.hstack(t)
    values, worst, go_on, lead = spectral.ritz(e.T @ e, 4, 3)
    assert worst < 1e-5 and np.allclose(values, np.sort(np.linalg.eigvals(p).real)[::-1][:3], atol=1e-5)
    f = e[:, : len(lead)] @ lead
    assert np.allclose(f.T @ f, np.eye(f.shape[1]), atol=1e-6) and go_on.shape == (156, 4)


def test_large_clouds_are_iterated(spark, n=800):
    df = frame_of(spark, clouds(np.random.default_rng(3), n)[:2])
    got = cluster.spectral(df, ("frame",)).collect()
    want = {(0, frozenset(range(n))), (0, frozenset(range(n, 3 * n)))} | {(1, frozenset(range(100_000 + k * n, 100_000 + (k + 1) * n))) for k in range(3)}
    assert parts(got) == want
