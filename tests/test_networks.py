"""The networks that SQL does not follow, and iterative clusterings, against plain numpy."""

import numpy as np
import pytest

from pointmill.operators import cluster, networks
from pointmill.plans import network_queries, views


@pytest.fixture(scope="module")
def clouds(spark, sf_dir):
    p = views.pts3(spark, sf_dir).orderBy("pid").toPandas()
    return {f: g.reset_index(drop=True) for f, g in p.groupby("frame")}


def run_layers(m, layers, last=True):
    for k, layer in enumerate(layers):
        m = m @ layer.weight.T + layer.bias
        if last or k < len(layers) - 1:
            m = np.maximum(m, 0)
    return m


def farthest(xyz, n):
    chosen, far = [0], ((xyz - xyz[0]) ** 2).sum(1)
    while len(chosen) < n:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((xyz - xyz[chosen[-1]]) ** 2).sum(1))
    return chosen


def by_hand(xyz, net):
    """The classifier on one object; rows in order of their ids."""
    f, ids = None, np.arange(len(xyz))
    for n, scales in net["rounds"]:
        centres = sorted(set(farthest(xyz, min(n, len(xyz)))))
        rows = []
        for c in centres:
            parts = []
            for r, size, layers in scales:
                near = np.flatnonzero(((xyz - xyz[c]) ** 2).sum(1) <= r * r)[:size]
                near = np.concatenate([near, np.full(size - len(near), near[0])])
                put = [xyz[near] - xyz[c]] + ([f[near]] if f is not None else [])
                parts.append(run_layers(np.concatenate(put[::-1] if net.get("features_first") else put, 1), layers).max(0))
            rows.append(np.concatenate(parts))
        xyz, ids, f = xyz[centres], ids[centres], np.array(rows)
    z = run_layers(run_layers(np.concatenate([xyz, f], 1), net["whole"]).max(0)[None], net["head"], False)[0]
    return z - np.log(np.exp(z - z.max()).sum()) - z.max()


@pytest.mark.parametrize("name", ["_SINGLE", "_MULTI"])
def test_grouped_classifiers(spark, sf_dir, clouds, name):
    net = getattr(network_queries, name)
    got = {r["frame"]: r for r in networks.grouped_classifier(views.pts3(spark, sf_dir), ("frame",), net).collect()}
    assert set(got) == set(clouds)
    for frame, cloud in clouds.items():
        want = by_hand(cloud[["x", "y", "z"]].to_numpy(), net)
        assert np.allclose(got[frame]["scores"], want, atol=1e-9) and got[frame]["prediction"] == want.argmax()


def test_models_by_name_from_written_weights(spark, sf_dir, tmp_path):
    p = views.pts3(spark, sf_dir)
    for name, net in (("ssg", network_queries._SINGLE), ("msg", network_queries._MULTI | {"features_first": True})):
        networks.save(spark, net, str(tmp_path / name))
        again = networks.load(spark, str(tmp_path / name))
        assert [(part, [(v.weight.tolist(), v.bias.tolist()) if isinstance(v, networks.Dense) else v for v in x]) for part, x in sorted(networks._parts(net), key=str)] == [
            (part, [(v.weight.tolist(), v.bias.tolist()) if isinstance(v, networks.Dense) else v for v in x]) for part, x in sorted(networks._parts(again), key=str)
        ]
    networks.save(spark, network_queries._SINGLE, str(tmp_path / "w"))
    want, got = (sorted((r["frame"], r["scores"], r["prediction"]) for r in df.collect()) for df in (networks.grouped_classifier(p, ("frame",), network_queries._SINGLE), networks.classify(p, ("frame",), "ssg", str(tmp_path / "w"))))
    assert got == want
    with pytest.raises(ValueError, match="no model"):
        networks.classify(p, ("frame",), "nothing", "")


def test_normalisation_is_folded_in():
    rng = np.random.default_rng(1)
    layer, x = networks.drawn(3, (4,), 1)[0], rng.normal(size=(5, 3))
    mean, variance, scale, shift = rng.normal(size=4), rng.uniform(0.5, 2, 4), rng.normal(size=4), rng.normal(size=4)
    want = ((x @ layer.weight.T + layer.bias) - mean) / np.sqrt(variance + 1e-5) * scale + shift
    folded = layer.normalised(mean, variance, scale, shift)
    assert np.allclose(x @ folded.weight.T + folded.bias, want)


def test_mean_shift_reaches_its_modes(spark, sf_dir, clouds):
    p = views.pts3(spark, sf_dir)
    got = {r["pid"]: r["cluster"] for r in cluster.mean_shift(p, 1.5).collect()}
    rows = p.orderBy("pid").toPandas()
    xyz, ids = rows[["x", "y", "z"]].to_numpy(), rows["pid"].tolist()
    modes = xyz.copy()
    for k in range(len(modes)):
        while True:
            new = xyz[((xyz - modes[k]) ** 2).sum(1) <= 1.5**2].mean(0)
            moved, modes[k] = np.sqrt(((new - modes[k]) ** 2).sum()), new
            if moved <= 1e-3:
                break
    label, near = list(range(len(ids))), ((modes[:, None] - modes[None]) ** 2).sum(2) <= 0.75**2
    for k in range(len(ids)):
        stack, seen = [k], {k}
        while stack:
            for j in np.flatnonzero(near[stack.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        label[k] = min(seen)
    assert got == {i: ids[j] for i, j in zip(ids, label, strict=True)}
    with pytest.raises(RuntimeError):
        cluster.mean_shift(p, 1.5, max_iter=1)


def test_clusterings_find_separate_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    truth = np.repeat(np.arange(3), 40)
    xyz = centres[truth] + rng.normal(0, 0.4, (120, 3))
    df = spark.createDataFrame([(k, 0, *map(float, p)) for k, p in enumerate(xyz)], "pid long, frame int, x double, y double, z double").cache()
    parts = lambda found: {frozenset(np.flatnonzero(np.array(found) == c).tolist()) for c in set(found)}
    want = parts(truth.tolist())
    told = lambda out, name: parts([r[name] for r in out.orderBy("pid").collect()])
    assert told(cluster.spectral(df, ("frame",)), "cluster") == want
    # power iteration starts at random: most of each part lies in one blob
    found = told(cluster.power_iteration(cluster.knn_graph(df, 10), 3), "cluster")
    assert sum(len(p) for p in found) == 120 and sum(max(len(p & w) for w in want) for p in found) >= 80
    assert told(cluster.mean_shift(df, 3.0), "cluster") == want
    labels, mixture = cluster.gmm(df, cluster.spread_mixture(df, 3), max_iter=40)
    assert told(labels, "k") == want
    assert np.allclose(sorted(np.array(mixture.means)[:, 0]), sorted(xyz[truth == c][:, 0].mean() for c in range(3)), atol=1e-2)


def test_a_shrunken_component_starts_again(spark):
    rows = [(k, 0.0, 0.0, 0.0) for k in range(30)] + [(30 + k, float(5 + k % 3), float(k % 4), float(k % 5)) for k in range(30)]
    df = spark.createDataFrame(rows, "pid long, x double, y double, z double")
    labels, m = cluster.gmm(df, cluster.spread_mixture(df, 2), max_iter=30)
    assert all(np.isfinite(np.array(c)).all() and np.linalg.norm(c) > 0 for c in m.covariances) and labels.count() == 60
