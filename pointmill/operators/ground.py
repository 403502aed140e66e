"""Ground removal on point frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ, plane_through
from pointmill.functions.tables import written
from pointmill.operators import linalg

KEY = ("frame", "seg")


def seeds(df: DataFrame, key: Sequence[str] = KEY, lpr: int = 10_000, thr: float = 0.18, below: float = -1.23, id: str = "pid") -> DataFrame:
    """Candidates (z < below) with z under the mean of their `lpr` lowest plus `thr`; keys without candidates have none."""
    low = df.where(F.col("z") < below)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("z", id))
    mean = low.withColumn("_r", rank).where(F.col("_r") <= lpr).groupBy(*key).agg(F.avg("z").alias("lpr"))
    return low.join(mean, list(key)).where(F.col("z") < F.col("lpr") + thr)


def svd(df: DataFrame, key: Sequence[str] = KEY, iters: int = 6, lpr: int = 10_000, thr: float = 0.18, below: float = -1.23, id: str = "pid") -> DataFrame:
    """Adds is_ground: planes from the seeds, then `iters` rounds of all rows near the plane; all keys in each job.

    Each round's planes, a row a key, are written, so that a round reads the points once and none is computed again.
    """
    chosen = seeds(df, key, lpr, thr, below, id).select(*key, *XYZ)
    out = None
    for _ in range(iters):
        plane = written(linalg.plane_fit(chosen, key), "planes")
        near = linalg.plane_distance([F.col("nx"), F.col("ny"), F.col("nz")], F.col("d")) < thr
        out = df.join(plane, list(key)).withColumn("is_ground", F.coalesce(near, F.lit(False)))
        chosen = out.where("is_ground").select(*key, *XYZ)
    return out.select(*df.columns, "is_ground", "nx", "ny", "nz", "d")


def ransac_planes(points: DataFrame, iters: int, key: Sequence[str] = KEY, id: str = "pid") -> DataFrame:
    """`iters` planes of each key through three points drawn by an arithmetic rule of their rank."""
    w = Window.partitionBy(*key).orderBy(id)
    ranked = points.withColumn("_r", F.row_number().over(w) - 1).select(*key, "_r", *XYZ)
    sizes = points.groupBy(*key).agg(F.count("*").alias("_n")).where("_n >= 3").withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iters - 1))))
    draws = sizes
    for j, (m, a) in enumerate(((7919, 17), (104729, 29), (1299709, 41))):
        draws = draws.withColumn(f"_r{j}", F.pmod(F.col("iter") * m + a, F.col("_n")))
    for j in range(3):
        draws = draws.join(ranked.select(*key, F.col("_r").alias(f"_r{j}"), *[F.col(c).alias(f"_{c}{j}") for c in XYZ]), [*key, f"_r{j}"])
    abcd = plane_through([[F.col(f"_{c}{j}") for c in XYZ] for j in range(3)])
    return draws.select(*key, "iter", *[v.alias(n) for v, n in zip(abcd, ("nx", "ny", "nz", "d"), strict=True)]).where(F.col("nx").isNotNull())


def ransac(df: DataFrame, key: Sequence[str] = KEY, iters: int = 40, thr: float = 0.15, lpr: int = 40_000, seed_thr: float = 1.0, below: float = -1.23, id: str = "pid") -> DataFrame:
    """Adds is_ground: the drawn plane with the most seeds within `thr`, ties to the earlier draw."""
    chosen = seeds(df, key, lpr, seed_thr, below, id)
    planes = ransac_planes(chosen, iters, key, id)
    n = [F.col("nx"), F.col("ny"), F.col("nz")]
    score = chosen.select(*key, *XYZ).join(planes, list(key)).groupBy(*key, "iter", "nx", "ny", "nz", "d").agg(F.count_if(linalg.plane_distance(n, F.col("d")) < thr).alias("score"))
    best = score.groupBy(*key).agg(F.max_by(F.struct("iter", "nx", "ny", "nz", "d", "score"), F.struct("score", -F.col("iter"))).alias("b")).select(*key, "b.*")
    return df.join(best, list(key)).select(*df.columns, (linalg.plane_distance(n, F.col("d")) < thr).alias("is_ground"), "iter", "score")


def range_image(df: DataFrame, res: float = 0.7, key: Sequence[str] = ("frame",), id: str = "pid", keep: str = "last") -> DataFrame:
    """(key.., row, col, range, pid, n): spherical pixels; each holds its last point (or its nearest), empty rows and columns are squeezed out."""
    rad = F.lit(res * 3.141592653589793 / 180)
    w, h = int(360 / res) + 1, int(60 / res) + 1
    az = F.floor(F.atan2("y", "x") / rad)
    el = F.floor(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) / rad)
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    put = df.select(*key, F.col(id).alias("pid"), d.alias("range"), (h - 1 - (el + (h + 1) // 2)).cast("int").alias("_row"), (w - 1 - (az + (w + 1) // 2)).cast("int").alias("_col"))
    order = F.struct("pid") if keep == "last" else F.struct(-F.col("range"), -F.col("pid"))
    px = put.groupBy(*key, "_row", "_col").agg(F.max_by(F.struct("range", "pid"), order).alias("p"), F.count("*").alias("n"))
    # numbers among the rows and columns that exist: a frame has at most a few hundred of each
    for name in ("row", "col"):
        line = px.select(*key, f"_{name}").distinct().withColumn(name, (F.row_number().over(Window.partitionBy(*key).orderBy(f"_{name}")) - 1).cast("int"))
        px = px.join(line, [*key, f"_{name}"])
    return px.select(*key, "row", "col", F.col("p.range").alias("range"), F.col("p.pid").alias("pid"), "n", "_row", "_col")


def pixel_of(df: DataFrame, res: float = 0.7, key: Sequence[str] = ("frame",), id: str = "pid") -> DataFrame:
    """(key.., pid, prow, pcol): the raw spherical pixel of every point."""
    rad = F.lit(res * 3.141592653589793 / 180)
    w, h = int(360 / res) + 1, int(60 / res) + 1
    az = F.floor(F.atan2("y", "x") / rad)
    el = F.floor(F.atan2(F.col("z"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))) / rad)
    return df.select(*key, F.col(id).alias("pid"), (h - 1 - (el + (h + 1) // 2)).cast("int").alias("prow"), (w - 1 - (az + (w + 1) // 2)).cast("int").alias("pcol"))
