"""Spectral clustering of clouds of any size.

The eigenvectors of the least eigenvalues of I - P are those of the greatest of P, the row-normalised neighbour graph. Small
clouds are dense problems inside a task. Others are iterated: a few columns are multiplied with P, STEPS times in the Chebyshev
basis; the inner products of all these columns (numbers of columns x columns, whatever the cloud's size) give the best vectors
of their span, with their residuals; the next round starts from those. Clouds of bounded size do so inside a task, larger
ones all together over the edge table: a product is a join and a sum, and nothing of a cloud's size meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.tables import written

#: Points of a cloud that is a dense problem, and of one that is iterated inside a task.
DENSE, BLOCK = 600, 30_000
#: Columns beyond the wanted eigenvectors, products in a round, rounds.
EXTRA, STEPS, ROUNDS = 4, 16, 80
#: Residual of a leading eigenvector that counts as found, and the share by which the wanted eigenvalues may still move then.
TOLERANCE, STILL = 1e-6, 0.01


def leading(values: np.ndarray) -> int:
    """How many of the ascending eigenvalues of I - P come before the first gap over fifty times the first one; 1 without such a gap."""
    gaps = np.diff(values)
    jump = np.flatnonzero(gaps > 50 * max(gaps[0], 1e-9)) if gaps.size else np.empty(0, int)
    return int(jump[0]) + 1 if jump.size else 1


def real_span(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Real columns of the same span: a conjugate pair's two vectors become their real and imaginary parts."""
    return np.where(values.imag < 0, vectors.imag, vectors.real)


def orthonormal(vectors: np.ndarray, inner: np.ndarray, least: float = 1e-14) -> np.ndarray:
    """Combinations of the columns that are orthonormal under the inner product; directions of less than a share `least` are left out."""
    size, turn = np.linalg.eigh(vectors.T @ inner @ vectors)
    keep = size > least * max(size[-1], 1e-300)
    return vectors @ turn[:, keep] / np.sqrt(size[keep])


def lloyd(points: np.ndarray, count: int, tol: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """Labels by k-means from the first row and then the rows farthest from the centres so far."""
    centres = points[:1]
    while len(centres) < count:
        centres = np.vstack([centres, points[((points[:, None] - centres[None]) ** 2).sum(2).min(1).argmax()]])
    label = np.zeros(len(points), int)
    for _ in range(rounds):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(count)])
        moved, centres = np.abs(new - centres).max(), new
        if moved < tol:
            return label
    raise RuntimeError(f"centres still move after {rounds} rounds")


def _solve(frame: pd.DataFrame, key: Sequence[str], estimate: int, dense: int) -> pd.DataFrame:
    frame = frame.sort_values(["src", "dst"])
    nodes, flat = np.unique(np.concatenate([frame["src"], frame["dst"]]), return_inverse=True)
    src, dst, w = flat[: len(frame)], flat[len(frame) :], frame["w"].to_numpy()
    points, count = _dense(src, dst, w, nodes.size, estimate) if nodes.size <= dense else iterated(src, dst, w, nodes.size, estimate)
    label = lloyd(points, count)
    first = {c: i for i, c in enumerate(dict.fromkeys(label.tolist()))}
    return pd.DataFrame({**{c: frame[c].iloc[0] for c in key}, "pid": nodes, "cluster": [first[c] for c in label.tolist()]})


def _dense(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, estimate: int) -> tuple[np.ndarray, int]:
    lap = np.eye(n)
    np.subtract.at(lap, (src, dst), w)
    values, vectors = np.linalg.eig(lap)
    order = np.argsort(values.real, kind="stable")[: min(estimate, n)]
    count = leading(values.real[order])
    some = order[:count]
    return orthonormal(real_span(values[some], vectors[:, some]), np.eye(n)), count  # the same distances whatever basis the solver took


# --- iteration ----------------------------------------------------------------------------------


def ritz(gram: np.ndarray, columns: int, estimate: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The greatest eigenvalues of P in the span of Chebyshev columns, the largest residual of the leading ones, coefficients
    of the columns to go on with, and of an orthonormal basis of the leading eigenvectors.

    `gram` holds the inner products of the columns T_0 V .. T_(s+1) V; P times the first s + 1 blocks lies in their span.
    """
    blocks = gram.shape[0] // columns
    inner, eye = (blocks - 1) * columns, np.eye(columns)
    times = np.zeros((gram.shape[0], inner))
    for j in range(blocks - 1):
        for k, share in ((1, 1.0),) if j == 0 else ((j + 1, 0.5), (j - 1, 0.5)):
            times[k * columns : (k + 1) * columns, j * columns : (j + 1) * columns] = share * eye
    size = np.sqrt(np.maximum(np.diag(gram)[:inner], 1e-300))
    values, basis = np.linalg.eigh(gram[:inner, :inner] / size[:, None] / size[None])
    keep = values > 1e-12 * values[-1]
    basis = basis[:, keep] / np.sqrt(values[keep]) / size[:, None]
    found, small = np.linalg.eig(basis.T @ (gram[:inner] @ times) @ basis)
    order = np.argsort(-found.real, kind="stable")
    found, y = found[order], basis @ small[:, order]
    wanted = min(estimate, found.size)
    count = leading(1 - found.real[:wanted])
    off = times @ y[:, :count]
    off[:inner] -= y[:, :count] * found[:count]
    norm = lambda c, g: np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", c.conj(), g, c).real, 0.0))
    worst = float((norm(off, gram) / np.maximum(norm(y[:, :count], gram[:inner, :inner]), 1e-300)).max())
    go_on = real_span(found[:columns], y[:, :columns])
    return found.real[:wanted], worst, go_on / np.maximum(norm(go_on, gram[:inner, :inner]), 1e-300), orthonormal(real_span(found[:count], y[:, :count]), gram[:inner, :inner])


def settled(values: np.ndarray, before: np.ndarray | None, worst: float, tol: float) -> bool:
    """Whether the leading vectors are found, and no wanted eigenvalue moves enough to change how many there are."""
    if before is None or len(before) != len(values) or worst > tol:
        return False
    a, b = 1 - np.asarray(values), 1 - np.asarray(before)
    return bool((np.abs(a - b) <= STILL * np.abs(b) + 1e-9).all())


def iterated(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int, estimate: int, tol: float = TOLERANCE, steps: int = STEPS, rounds: int = 20 * ROUNDS) -> tuple[np.ndarray, int]:
    """An orthonormal basis of the leading eigenvectors of a cloud of n nodes with edges in the order of src, and their number."""
    columns, first = estimate + EXTRA, np.searchsorted(src, np.arange(n))
    times = lambda x: np.add.reduceat(x[dst] * w[:, None], first)
    v = np.random.default_rng(n).standard_normal((n, columns))
    v[:, 0] = 1.0
    before = None
    for _ in range(rounds):
        held = [v]
        for step in range(1, steps + 2):
            held.append(times(held[-1]) if step == 1 else 2 * times(held[-1]) - held[-2])
        basis = np.hstack(held)
        size = np.maximum(np.sqrt((basis**2).sum(0)), 1e-300)
        x = basis @ (orthonormal(np.diag(1 / size), basis.T @ basis, 1e-10))
        x = x @ orthonormal(np.eye(x.shape[1]), x.T @ x)  # once more, for what rounding left
        turned = np.hstack([times(x[:, k : k + columns]) for k in range(0, x.shape[1], columns)])
        values, small = np.linalg.eig(x.T @ turned)
        order = np.argsort(-values.real, kind="stable")
        values, small = values[order], small[:, order]
        found = values.real[: min(estimate, values.size)]
        count = leading(1 - found)
        off = turned @ small[:, :count] - (x @ small[:, :count]) * values[:count]
        if settled(found, before, float(np.sqrt((np.abs(off) ** 2).sum(0)).max()), tol):
            return x @ orthonormal(real_span(values[:count], small[:, :count]), np.eye(x.shape[1])), count
        before, v = found, x @ real_span(values[:columns], small[:, :columns])
        v = np.hstack([v, np.random.default_rng(n).standard_normal((n, columns - v.shape[1]))])  # the space is exhausted: any will do
    raise RuntimeError(f"eigenvectors not found to {tol} in {rounds} rounds")


def _basis(edges: DataFrame, start: DataFrame, columns: int, steps: int) -> DataFrame:
    """(g, node, e): the Chebyshev columns T_0 V .. T_(steps+1) V of every node as one array, written.

    A product reads the node table twice, so each one is written before the next.
    """
    state = written(start.select("g", "node", F.array(*[f"v{k}" for k in range(columns)]).alias("t")).withColumn("e", F.col("t")), "chebyshev")
    for step in range(1, steps + 2):
        other = state.select(F.col("g").alias("_g"), F.col("node").alias("_n"), "t")
        joined = edges.join(other, (edges["g"] == other["_g"]) & (edges["dst"] == other["_n"]))
        product = joined.groupBy("g", F.col("src").alias("node")).agg(F.array(*[F.sum(F.col("w") * F.get("t", k)) for k in range(columns)]).alias("m"))
        last = F.slice("e", (step - 2) * columns + 1, columns)  # of the step before
        new = F.col("m") if step == 1 else F.zip_with("m", last, lambda x, y: 2 * x - y)
        state = written(state.drop("t").join(product, ["g", "node"]).select("g", "node", new.alias("t"), "e").withColumn("e", F.concat("e", "t")), "chebyshev")
    return state.select("g", "node", "e")


def _grams(basis: DataFrame, size: int) -> DataFrame:
    """(g, row, values): the inner products of the columns of each cloud; tasks add up first, then Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for g, gram in held.items():
                yield pa.RecordBatch.from_pydict({"g": pa.array([g] * size, pa.int64()), "row": pa.array(range(size), pa.int32()), "x": pa.array(list(gram), pa.list_(pa.float64()))})

        for batch in batches:
            if batch.num_rows:
                e, names = np.array(batch.column("e").flatten()).reshape(batch.num_rows, size), batch.column("g").to_numpy()
                for g in np.unique(names).tolist():
                    mine = e[names == g]
                    held[g] = held.get(g, 0.0) + mine.T @ mine
                if len(held) > 32:
                    yield from out()
                    held = {}
        yield from out()

    told = basis.select("g", "e").mapInArrow(add, "g long, row int, x array<double>")
    return told.groupBy("g", "row").agg(F.array(*[F.sum(F.get("x", k)) for k in range(size)]).alias("values"))


def _combined(basis: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """(g, node, f): the columns of each node combined by its cloud's coefficients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, e = batch.column("g").to_numpy(), batch.column("e")
            for g in np.unique(names).tolist():
                at = np.flatnonzero(names == g)
                x = np.array(e.take(pa.array(at)).flatten()).reshape(at.size, -1)
                y = np.array(batch.column("y")[int(at[0])].as_py())
                y = y.reshape(-1, y.size // batch.column("width")[int(at[0])].as_py()) if y.size else y.reshape(0, 0)
                yield pa.RecordBatch.from_pydict({"g": pa.array([g] * at.size, pa.int64()), "node": batch.column("node").take(pa.array(at)), "f": pa.array(list(x[:, : len(y)] @ y), pa.list_(pa.float64()))})

    return basis.join(weights.select("g", F.col(column).alias("y"), "width"), "g").mapInArrow(run, "g long, node long, f array<double>")


def leading_vectors(edges: DataFrame, estimate: int, tol: float = TOLERANCE, steps: int = STEPS, rounds: int = ROUNDS) -> DataFrame:
    """(g, node, f, count): each node's entries in an orthonormal basis of the `count` leading eigenvectors of its cloud g.

    `edges` is a written table (g, src, dst, w) whose weights add up to 1 for each source. Raises if a residual is over `tol` after
    all rounds.
    """
    columns = estimate + EXTRA
    size = columns * (steps + 2)
    draw = lambda k: (F.xxhash64("node", F.lit(k)) / F.lit(float(1 << 63))).alias(f"v{k}")
    start = edges.select("g", F.col("src").alias("node")).distinct().select("g", "node", F.lit(1.0).alias("v0"), *[draw(k) for k in range(1, columns)])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        gram = np.stack(frame.sort_values("row")["values"].to_list())
        values, worst, go_on, lead = ritz(gram, columns, estimate)
        missing = columns - go_on.shape[1]  # fewer vectors than columns: a very small cloud
        go_on = np.hstack([go_on, np.zeros((len(go_on), missing))])
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "worst": [worst], "go_on": [go_on.ravel().tolist()], "lead": [lead.ravel().tolist()], "width": [len(go_on)], "count": [leading(1 - values)], "values": [values.tolist()]})

    before = None
    for _ in range(rounds):
        basis = _basis(edges, start, columns, steps)
        told = written(_grams(basis, size).groupBy("g").applyInPandas(solve, "g long, worst double, go_on array<double>, lead array<double>, width int, count int, values array<double>"), "ritz")
        if before is not None:
            moved = F.array_max(F.zip_with("values", "old", lambda a, b: F.abs(a - b) - STILL * F.abs(1 - b)))
            open_ = told.join(before, "g").where((F.col("worst") > tol) | (F.size("values") != F.size("old")) | (moved > 1e-9))
            if open_.isEmpty():  # see settled()
                return written(_combined(basis, told, "lead").join(told.select("g", "count"), "g"), "features")
        before = told.select("g", F.col("values").alias("old"))
        start = _combined(basis, told, "go_on").select("g", "node", *[F.get("f", k).alias(f"v{k}") for k in range(columns)])
    raise RuntimeError(f"eigenvectors not found to {tol} in {rounds} rounds")


def _labels(features: DataFrame, tol: float = 1e-6, rounds: int = 200) -> DataFrame:
    """(g, node, label): k-means of every cloud's rows, as many centres as entries; labels are numbered by their least node.

    Starts like lloyd(). A round is one pass: tasks add up what is nearest to each centre, so a cloud sends a few rows.
    """
    size = features.groupBy("g").agg(F.max("count").alias("count"), F.max(F.size("f")).alias("width"), F.min_by("f", "node").alias("first"))
    features, wide = features.drop("count"), int(size.agg(F.max("width")).first()[0] or 1)
    centres = written(size.select("g", "count", F.array("first").alias("c")), "centres")
    near = lambda f, c: F.array_min(F.transform(c, lambda p, i: F.struct(F.aggregate(F.zip_with(f, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), i.alias("k"))))
    most = int(centres.agg(F.max("count")).first()[0] or 1)
    for _ in range(most - 1):
        far = features.join(centres, "g").where(F.size("c") < F.col("count")).select("g", "f", "node", near(F.col("f"), F.col("c"))["d"].alias("d"))
        far = far.groupBy("g").agg(F.max_by("f", F.struct("d", (-F.col("node")).alias("n"))).alias("f"))
        centres = written(centres.join(far, "g", "left").select("g", "count", F.when(F.col("f").isNull(), F.col("c")).otherwise(F.concat("c", F.array("f"))).alias("c")), "centres")
    for _ in range(rounds):
        mine = features.join(centres, "g").select("g", "f", near(F.col("f"), F.col("c"))["k"].alias("k"))
        means = mine.groupBy("g", "k").agg(F.array(*[F.avg(F.get("f", i)) for i in range(wide)]).alias("m")).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("m"))
        moved = centres.join(means, "g").select("g", "count", F.col("c").alias("old"), F.transform("c", lambda p, i: F.coalesce(F.slice(F.element_at("m", i), 1, F.size(p)), p)).alias("c"))
        moved = written(moved, "centres")
        step = F.array_max(F.transform(F.arrays_zip("old", "c"), lambda z: F.array_max(F.zip_with(z["old"], z["c"], lambda a, b: F.abs(a - b)))))
        centres = moved.drop("old")
        if (moved.agg(F.max(step)).first()[0] or 0.0) < tol:
            break
    else:
        raise RuntimeError(f"centres still move after {rounds} rounds")
    raw = written(features.join(centres, "g").select("g", "node", near(F.col("f"), F.col("c"))["k"].alias("k")), "labels")
    order = raw.groupBy("g", "k").agg(F.min("node").alias("n")).withColumn("label", F.row_number().over(Window.partitionBy("g").orderBy("n")) - 1)  # a row a cluster
    return raw.join(order.select("g", "k", "label"), ["g", "k"]).select("g", "node", "label")


def spectral(df: DataFrame, key: Sequence[str] = (), k: int = 10, estimate: int = 8, dense: int = DENSE, block: int = BLOCK, id: str = "pid") -> DataFrame:
    """(key.., pid, cluster): spectral clustering of every key's cloud on its own graph of k nearest neighbours.

    The number of clusters is where the eigenvalues of I - P first jump, among the `estimate` least. Clouds of at most `block` points
    are solved inside a task, larger ones over the edge table; all give the same clusters. A cloud of one point is one
    cluster; points at the same place are neighbours at the least distance. Clusters are numbered in the order of their first id.
    """
    from pointmill.operators.cluster import knn_graph

    if not key:
        return spectral(df.withColumn("_one", F.lit(0)), ("_one",), k, estimate, dense, block, id).drop("_one")
    edges = written(knn_graph(df, k, key, id), "edges")
    sizes = written(edges.groupBy(*key).agg(F.count_distinct("src").alias("n")).withColumn("g", F.monotonically_increasing_id()), "clouds")
    on = list(key)
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in key) + ", pid long, cluster int"
    small = edges.join(sizes.where(F.col("n") <= block).drop("n", "g"), on, "left_semi")
    found = small.groupBy(*key).applyInPandas(lambda frame: _solve(frame, key, estimate, dense), schema)
    large = sizes.where(F.col("n") > block).drop("n")
    if not large.isEmpty():
        much = written(edges.join(large, on).select("g", "src", "dst", "w"), "edges")
        told = _labels(leading_vectors(much, estimate))
        told = told.join(large, "g").select(*key, F.col("node").alias("pid"), F.col("label").cast("int").alias("cluster"))
        found = found.unionByName(told)
    named = found.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("pid").alias("_pid"), "cluster")
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col(id) == F.col("_pid")]
    joined = df.select(*key, id)
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return joined.join(named, condition, "left").select(*key, F.col(id).alias("pid"), F.coalesce("cluster", F.lit(0)).alias("cluster"))
