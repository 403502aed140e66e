"""Sums, scatter matrices, planes and normals per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.geometry import SYM, XYZ, with_eigen
from pointmill.operators import spatial


def stats(df: DataFrame, key: Sequence[str] = (), cols: Sequence[str] = XYZ) -> DataFrame:
    """Count, centroid (mx, my, mz), bounds and the unnormalised scatter matrix of each key, in one aggregate."""
    x, y, z = cols
    n = F.count("*")
    pairs = ((x, x), (x, y), (x, z), (y, y), (y, z), (z, z))
    return df.groupBy(*key).agg(
        n.alias("n"),
        *[F.avg(c).alias(f"m{a}") for c, a in zip(cols, "xyz", strict=True)],
        *[F.min(c).alias(f"min{a}") for c, a in zip(cols, "xyz", strict=True)],
        *[F.max(c).alias(f"max{a}") for c, a in zip(cols, "xyz", strict=True)],
        *[(F.covar_pop(a, b) * n).alias(s) for s, (a, b) in zip(SYM, pairs, strict=True)],
    )


def pca(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """stats() with eigenvalues and the direction of the least one."""
    return with_eigen(stats(df, key))


def plane_fit(df: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(key.., n, nx, ny, nz, d): the least-squares plane n.p + d = 0 of each key."""
    p = pca(df, key)
    d = -(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))
    return p.select(*key, "n", "nx", "ny", "nz", d.alias("d"))


def plane_distance(n: Sequence[Column], d: Column, cols: Sequence[str] = XYZ) -> Column:
    """|n.p + d|."""
    return F.abs(n[0] * F.col(cols[0]) + n[1] * F.col(cols[1]) + n[2] * F.col(cols[2]) + d)


def neighbour_stats(pairs: DataFrame, base: DataFrame, key: Sequence[str] = (), id: str = "pid") -> DataFrame:
    """stats() of the neighbours of each query."""
    points = base.select(*key, F.col(id).alias("nid"), *XYZ)
    return stats(pairs.join(points, [*key, "nid"]), [*key, "qid"])


def normals(df: DataFrame, k: int, r: float | None = None, key: Sequence[str] = (), id: str = "pid", least: int = 3) -> DataFrame:
    """(key.., pid, n_neigh, nx, ny, nz): direction of least spread of the k nearest (at most r away); zero under `least` neighbours."""
    if r is None:
        pairs = spatial.knn(df, df, k, key=key, qid=id, bid=id)
    else:
        pairs = spatial.nearest(spatial.radius_join(df, df, r, key, id, id), k, key)
    s = with_eigen(neighbour_stats(pairs, df, key, id))
    zero = lambda c: F.when(F.col("n") >= least, F.col(c)).otherwise(0.0).alias(c)
    return s.select(*key, F.col("qid").alias(id), F.col("n").alias("n_neigh"), zero("nx"), zero("ny"), zero("nz"), "l1", "l2", "l3")


def weighted_cov(pairs: DataFrame, base: DataFrame, key: Sequence[str] = (), id: str = "pid") -> DataFrame:
    """Covariance of each query's neighbours about the query itself, weights 1 / |N(neighbour)|; pairs hold self."""
    count = pairs.groupBy(*key, F.col("qid").alias("nid")).agg(F.count("*").alias("_m"))
    a = base.select(*key, F.col(id).alias("qid"), *[F.col(c).alias(f"_q{c}") for c in XYZ])
    b = base.select(*key, F.col(id).alias("nid"), *[F.col(c).alias(f"_n{c}") for c in XYZ])
    j = pairs.join(count, [*key, "nid"]).join(a, [*key, "qid"]).join(b, [*key, "nid"]).withColumn("_w", 1.0 / F.col("_m"))
    d = {c: F.col(f"_n{c}") - F.col(f"_q{c}") for c in XYZ}
    sym = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))
    return j.groupBy(*key, "qid").agg(F.count("*").alias("n"), *[(F.sum(F.col("_w") * d[p] * d[q]) / F.sum("_w")).alias(s) for s, (p, q) in zip(SYM, sym, strict=True)])


def median(df: DataFrame, col: str, key: Sequence[str] = (), side: str = "lower") -> DataFrame:
    """The element of rank (n-1)//2 (lower) or n//2 (upper), from 0, of each key."""
    value = F.expr(f"percentile_disc(0.5) within group (order by `{col}`)")
    if side == "upper":
        value = F.expr(f"percentile_disc(0.5) within group (order by `{col}` desc)")
    return df.groupBy(*key).agg(value.alias("median"))
