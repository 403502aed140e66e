"""Operators on embeddings against brute force: awkward rows, groups of copies, small parts and blocks."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.llm import hard_negatives, lattice, queries, vectors, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, v int, x string, ball double, node long, n long, ar string"


def unit(v):
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def rows():
    """Copies, a tight group, a wide group, a chain, scaled vectors, short, empty, zero and broken ones, null and repeated ids."""
    rng = np.random.default_rng(7)
    out = [(k, rng.standard_normal(16), k % 4) for k in range(120)]
    near = lambda base, size: unit(base) + size * unit(rng.standard_normal(16))
    tight, wide = rng.standard_normal(16), rng.standard_normal(16)
    out += [(200 + k, near(tight, 0.12), k % 3) for k in range(60)]
    out += [(300 + k, near(wide, 0.33), 1) for k in range(40)]
    step = rng.standard_normal(16)
    for k in range(12):
        step = near(step, 0.4)
        out.append((400 + k, step, 2))
    same = rng.standard_normal(16)
    out += [(500 + k, same, k % 2) for k in range(25)] + [(530, 3 * same, 1), (531, same * 1e-30, 1), (None, same, 1), (None, same, None)]
    out += [(600, None, 1), (601, [0.0] * 16, 1), (602, [], 1), (603, [1.0, None] + [0.0] * 14, 1), (604, [math.inf] + [1.0] * 15, 1), (605, [math.nan] * 16, 1), (606, [1.0, 2.0], 1), (607, [1.0, 2.0] + [0.0] * 14, 1)]
    out += [(50, out[50][1], 2), (50, out[50][1], 2), (100, rng.standard_normal(16), None), (0, [-x for x in out[0][1]], 0)]
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], y) for i, v, y in out]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "x", 0.5, 2, 3, "y") for r in rows], SCHEMA).repartition(3).cache()


def valid(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def classes_by_hand(rows, least=0.9):
    d = max(len(v) for _, v, _ in rows if v is not None)
    x = np.array([[*v, *[0.0] * (d - len(v))] if valid(v) else [0.0] * d for _, v, _ in rows])
    size = np.sqrt(((x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)) ** 2).sum(1)) * np.abs(x).max(1)
    u = x / np.where(size > 0, size, 1)[:, None]
    links = (u @ u.T >= least) & ~np.eye(len(rows), dtype=bool)
    name = list(range(len(rows)))
    for _ in rows:
        new = [min([name[i], *(name[j] for j in np.flatnonzero(links[i]))]) for i in range(len(rows))]
        if new == name:
            break
        name = new
    ids = {c: min((rows[i][0] for i in range(len(rows)) if name[i] == c and rows[i][0] is not None), default=None) for c in set(name)}
    return sorted(((rows[i][0], int(links[i].sum()), ids[name[i]], rows[i][0] == ids[name[i]]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("how", [{}, {"part": 16, "bucket_part": 40, "block": 7}])
def test_linked_vectors_equal_brute_force(frame, rows, how):
    got = lattice.classes(frame, tables=40, **how)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == classes_by_hand(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """Production parameters on pairs of cosine 0.9 to 0.92, which are the hardest."""
    rng = np.random.default_rng(1)
    made = []
    for k in range(400):
        a, z = unit(rng.standard_normal(64)), rng.standard_normal(64)
        z, c = unit(z - (z @ a) * a), 0.9 + 0.02 * rng.random()
        made += [(2 * k, a.tolist()), (2 * k + 1, (c * a + math.sqrt(1 - c * c) * z).tolist())]
    x = np.array([v for _, v in made])
    want = int(((x @ x.T >= 0.9).sum() - len(x)))
    got = lattice.classes(spark.createDataFrame(made, "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert want >= 790 and 0.9 * want <= got <= want


def test_a_group_of_near_copies_makes_few_pairs(spark, tmp_path):
    """A third of all rows near one vector: candidates are balls, not pairs of rows."""
    rng = np.random.default_rng(2)
    base = unit(rng.standard_normal(64))
    made = [unit(base + 0.1 * unit(rng.standard_normal(64))) for _ in range(1500)] + [unit(rng.standard_normal(64)) for _ in range(3000)]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], "vec_id long, embedding array<double>")
    seen = []
    verdicts = lattice.verdicts
    lattice.verdicts = lambda pairs, *a: seen.append(pairs.count()) or verdicts(pairs, *a)
    try:
        got = {r["vec_id"]: r for r in lattice.classes(df, part=300).collect()}
    finally:
        lattice.verdicts = verdicts
    assert [(got[k]["n_links"], got[k]["component_id"]) for k in range(1500)] == [(1499, 0)] * 1500
    assert seen[0] < 20_000


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    x = 3 * rng.standard_normal((500, 8))
    got = lattice.decode(x)
    assert np.all(np.mod(got.sum(1), 2) == 0) and all(len(np.unique(np.mod(r, 1))) == 1 for r in got)
    best = ((x - got) ** 2).sum(1)
    assert all((best <= ((x - (got + v)) ** 2).sum(1) + 1e-9).all() for v in lattice.NEIGHBOURS) and best.max() <= 1 + 1e-9


def whitened_by_hand(rows):
    d = max(len(v) for _, v, _ in rows if v is not None)
    x = [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v))) for i, v, _ in rows if valid(v)]
    fit = sorted({tuple(v) for _, v in x})
    n = len(fit)
    s = [sum(v[k] for v in fit) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit), n**3)) for b in range(d)] for a in range(d)])
    return x, n, s, cov


def test_whitening_equals_fractions(frame, rows):
    x, n, s, cov = whitened_by_hand(rows)
    told, model, error = whitening.whiten(frame)
    assert (model.n, model.sums) == (n, s) and error < 1e-9
    values, found = np.linalg.eigh(cov)
    assert np.allclose(model.eigenvalues, values[::-1][:4], rtol=1e-12) and math.isclose(model.trace, float(np.trace(cov)), rel_tol=1e-14)
    want = {}
    for i, v in x:
        y = [n * c - t for c, t in zip(v, s, strict=True)]
        w = [float(np.array([c / n for c in y]) @ found[:, -1 - k] / math.sqrt(values[-1 - k])) for k in range(4)]
        want.setdefault(str(i), []).append((sum(c * c for c in y), [abs(a) for a in w]))
    got = {}
    for r in told.collect():
        got.setdefault(str(r["vec_id"]), []).append((int(r["deviation"]), [abs(a) for a in r["whitened"]]))
    assert got.keys() == want.keys()
    for i, mine in want.items():
        assert len(mine) == len(got[i])
        for (a, b), (c, e) in zip(sorted(mine), sorted(got[i]), strict=True):
            assert a == c and np.allclose(b, e, atol=1e-8)


def test_products_of_limbs_are_exact(spark):
    """Numbers whose products float64 doesn't hold, over several limbs, and beyond 64 bits."""
    rng = np.random.default_rng(4)
    for size in (2**30, 2**45, 2**61):
        x = rng.integers(-size, size, (200, 5))
        fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(3)
        n, s, most = whitening.moments(fit, 5)
        exact = [[n * int(c) - sum(map(int, x[:, k])) for k, c in enumerate(r)] for r in x.tolist()]
        assert n == 200 and s == [sum(map(int, x[:, k])) for k in range(5)] and most >= max(abs(c) for r in exact for c in r)
        assert whitening.products(fit, n, s, most) == [[sum(r[a] * r[b] for r in exact) for b in range(5)] for a in range(5)]


def test_whitening_without_variance(spark, frame):
    assert whitening.whiten(frame.where("false"))[0].collect() == []
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (None, [0.5, 0.25])], "vec_id long, embedding array<float>")
    told, model, error = whitening.whiten(one)
    assert error is None and model.n == 1 and sorted(str(tuple(r)) for r in told.collect()) == sorted(str((i, told.first()["deviation"], [None, None])) for i in (1, 2, None))
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in range(9)], "vec_id long, embedding array<float>")
    told, model, error = whitening.whiten(line)
    assert model.varies().tolist() == [True, False, False] and error < 1e-12 and told.first()["whitened"][1:] == [None, None]


def negatives_by_hand(rows):
    d = max(len(v) for _, v, _ in rows if v is not None)
    use = [(i, [math.floor(256 * c) for c in v] + [0] * (d - len(v)), y) for i, v, y in rows if valid(v) and i is not None and y is not None]
    out = []
    for k, (i, x, y) in enumerate(use):
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, w, strict=True)), j, m) for m, (j, w, _) in enumerate(use) if m != k)
            for s, j, _ in [t for t in scored if use[t[2]][2] == y][:5]:
                inside = [t for t in scored if use[t[2]][2] != y and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
                out += [(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(frame, rows, monkeypatch):
    want = negatives_by_hand(rows)
    assert len(want) > 20
    anchors = F.col("vec_id") % 50 == 0
    assert sorted(map(tuple, hard_negatives.mine(frame, anchors).collect())) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 10)
    index = hard_negatives.index
    monkeypatch.setattr(hard_negatives, "index", lambda *a: index(*a, block=9))
    assert sorted(map(tuple, hard_negatives.mine(frame, anchors).collect())) == want
    assert hard_negatives.mine(frame.where("false"), anchors).collect() == [] == hard_negatives.mine(frame, F.lit(None).cast("boolean")).collect()


def test_bounds_hold_and_drop_most_rows():
    rng = np.random.default_rng(5)
    x = vectors.whole_numbers(np.array([unit(v) for v in rng.standard_normal((4000, 64))]))
    books = hard_negatives.codebooks(x[:2000].astype(float))
    w = hard_negatives.WIDTH
    codes = np.stack([hard_negatives.nearest(x[:, k * w : k * w + w].astype(float), b) for k, b in enumerate(books)]).astype(np.uint8)
    rest = np.stack([np.sqrt(((x[:, k * w : k * w + w] - b[c]) ** 2).sum(1)) for k, (b, c) in enumerate(zip(books, codes, strict=True))]).astype(np.float32)
    held = hard_negatives.Bounds({"n": len(x), "kind": "int64", "ids": np.arange(len(x)).tobytes(), "labels": np.zeros(len(x), np.int64).tobytes(), "x": x.tobytes(), "codes": codes.tobytes(), "residuals": rest.tobytes()}, books, 64)
    low, high = held.of(x[:40])
    true = x[:40] @ x.T
    assert (low <= true).all() and (true <= high).all()
    left = (high >= np.partition(low, -6, axis=1)[:, -6:-5]).mean()
    assert left < 0.05


def test_a_score_beyond_64_bits_raises():
    assert hard_negatives.exact(np.array([[2**40, -(2**40)]]), np.array([2**22, 2**22])).tolist() == [0]
    with pytest.raises(OverflowError):
        hard_negatives.exact(np.array([[2**40]]), np.array([2**40]))


def test_queries_on_awkward_tables(spark, frame, tmp_path):
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_lattice_neighbours", "op12_whitening", "op13_hard_negatives"):
        assert queries.queries()[name](spark, str(tmp_path)).count() > 0
    frame.where("false").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    for name in ("op11_lattice_neighbours", "op12_whitening", "op13_hard_negatives"):
        assert queries.queries()[name](spark, f"{tmp_path}/none").count() == 0
