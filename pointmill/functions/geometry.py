"""Geometry as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def sq_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Squared Euclidean distance of two tuples of columns."""
    total = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        total = total + (p - q) * (p - q)
    return total


def metric_distance(a: Sequence[Column], b: Sequence[Column], metric: str = "l2") -> Column:
    """l1, l2 (squared), so2 (angle on the circle of the first column) or so3 (squared quaternion difference)."""
    if metric == "l1":
        total = F.lit(0.0)
        for p, q in zip(a, b, strict=True):
            total = total + F.abs(p - q)
        return total
    if metric == "so2":
        d = b[0] - a[0]
        return F.abs(F.when(d > math.pi, d - 2 * math.pi).when(d < -math.pi, d + 2 * math.pi).otherwise(d))
    if metric in ("l2", "so3"):
        return sq_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def transformed(rotation: Sequence[Sequence[float]], shift: Sequence[float], cols: Sequence[str] = XYZ) -> list[Column]:
    """R p + t for the named columns."""
    c = [F.col(k) for k in cols]
    return [sum((c[j] * F.lit(float(rotation[i][j])) for j in range(3)), F.lit(float(shift[i]))).alias(cols[i]) for i in range(3)]


def wrap_to_pi(angle: Column) -> Column:
    """The angle in [-pi, pi]."""
    turn = 2 * math.pi
    m = F.pmod(angle, F.lit(turn))
    return F.when(m > math.pi, m - turn).otherwise(m)


def gaussian(x: Column, sigma: float) -> Column:
    return F.exp(-(x * x) / (2 * sigma * sigma))


def plane_through(p: Sequence[Sequence[Column]]) -> list[Column]:
    """(a, b, c, d) of the unit-normal plane through three points; null where they lie on a line."""
    u = [p[1][i] - p[0][i] for i in range(3)]
    v = [p[2][i] - p[0][i] for i in range(3)]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    a, b, c = (F.try_divide(k, size) for k in n)
    return [a, b, c, -(a * p[0][0] + b * p[0][1] + c * p[0][2])]


def quaternion(r: Sequence[Sequence[Column]]) -> list[Column]:
    """(w, x, y, z) of a rotation matrix, by its largest diagonal sum."""
    t = r[0][0] + r[1][1] + r[2][2]

    def branch(i: int, j: int, k: int) -> list[Column]:
        s = F.sqrt(F.greatest(r[i][i] - r[j][j] - r[k][k] + 1.0, F.lit(1e-300)))
        q = {0: (r[k][j] - r[j][k]) / (2 * s), i + 1: s / 2, j + 1: (r[j][i] + r[i][j]) / (2 * s), k + 1: (r[k][i] + r[i][k]) / (2 * s)}
        return [q[m] for m in range(4)]

    s = F.sqrt(F.greatest(t + 1.0, F.lit(1e-300)))
    positive = [s / 2, (r[2][1] - r[1][2]) / (2 * s), (r[0][2] - r[2][0]) / (2 * s), (r[1][0] - r[0][1]) / (2 * s)]
    x, y, z = branch(0, 1, 2), branch(1, 2, 0), branch(2, 0, 1)
    return [F.when(t > 0, positive[m]).when((r[0][0] >= r[1][1]) & (r[0][0] >= r[2][2]), x[m]).when(r[1][1] >= r[2][2], y[m]).otherwise(z[m]) for m in range(4)]


#: Names of the upper triangle of a symmetric 3x3 matrix.
SYM = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")


def with_eigen(df: DataFrame, sym: Sequence[str] = SYM) -> DataFrame:
    """Adds eigenvalues l1 >= l2 >= l3 and the unit eigenvector (nx, ny, nz) of l3 of a symmetric matrix.

    The trigonometric closed form; the eigenvector is the longest cross product of two rows of A - l3 I,
    with its largest component positive. It is null where l3 has no single direction.
    """
    a, b, c, d, e, f = (F.col(k) for k in sym)
    keep = df.columns
    out = df.withColumn("_q", (a + d + f) / 3)
    q = F.col("_q")
    out = out.withColumn("_p", F.sqrt(((a - q) ** 2 + (d - q) ** 2 + (f - q) ** 2 + 2 * (b * b + c * c + e * e)) / 6))
    p = F.col("_p")
    det = (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c)
    out = out.withColumn("_phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(0.0))))) / 3)
    out = out.withColumn("l1", q + 2 * p * F.cos("_phi")).withColumn("l3", q + 2 * p * F.cos(F.col("_phi") + 2 * math.pi / 3)).withColumn("l2", 3 * q - F.col("l1") - F.col("l3"))
    m = F.col("l3")
    rows = [(a - m, b, c), (b, d - m, e), (c, e, f - m)]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        u, v = rows[i], rows[j]
        out = out.withColumn(f"_v{k}", F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]))
    size = lambda v: F.element_at(v, 1) ** 2 + F.element_at(v, 2) ** 2 + F.element_at(v, 3) ** 2
    for k in range(3):
        out = out.withColumn(f"_s{k}", size(f"_v{k}"))
    s0, s1, s2 = (F.col(f"_s{k}") for k in range(3))
    out = out.withColumn("_v", F.when((s0 >= s1) & (s0 >= s2), F.col("_v0")).when(s1 >= s2, F.col("_v1")).otherwise(F.col("_v2"))).withColumn("_s", F.sqrt(F.greatest("_s0", "_s1", "_s2")))
    n = [F.try_divide(F.element_at("_v", i + 1), F.col("_s")) for i in range(3)]
    out = out.select(*keep, "l1", "l2", "l3", *[n[i].alias(f"_n{i}") for i in range(3)])
    n0, n1, n2 = (F.col(f"_n{i}") for i in range(3))
    big = F.when((F.abs(n0) >= F.abs(n1)) & (F.abs(n0) >= F.abs(n2)), n0).when(F.abs(n1) >= F.abs(n2), n1).otherwise(n2)
    sign = F.when(big < 0, -1.0).otherwise(1.0)
    return out.select(*keep, "l1", "l2", "l3", (n0 * sign).alias("nx"), (n1 * sign).alias("ny"), (n2 * sign).alias("nz"))


def eigen_sql(source: str, keep: str, tag: str = "e") -> str:
    """CTEs that add l1, l2, l3, nx, ny, nz to a relation with the columns of SYM, for DuckDB; the last is named `tag`."""
    return f"""
{tag}1 as (select *, (cxx + cyy + czz) / 3 as q_ from {source}),
{tag}2 as (select *, sqrt((power(cxx - q_, 2) + power(cyy - q_, 2) + power(czz - q_, 2) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) as p_ from {tag}1),
{tag}3 as (select *, acos(greatest(-1, least(1, case when p_ = 0 then 0 else ((cxx - q_) * ((cyy - q_) * (czz - q_) - cyz * cyz) - cxy * (cxy * (czz - q_) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q_) * cxz)) / (2 * p_ * p_ * p_) end))) / 3 as f_ from {tag}2),
{tag}4 as (select *, q_ + 2 * p_ * cos(f_) as l1, q_ + 2 * p_ * cos(f_ + 2 * pi() / 3) as l3 from {tag}3),
{tag}5 as (select *, 3 * q_ - l1 - l3 as l2,
  cxy * cyz - cxz * (cyy - l3) as a0, cxz * cxy - (cxx - l3) * cyz as a1, (cxx - l3) * (cyy - l3) - cxy * cxy as a2,
  cxy * (czz - l3) - cxz * cyz as b0, cxz * cxz - (cxx - l3) * (czz - l3) as b1, (cxx - l3) * cyz - cxy * cxz as b2,
  (cyy - l3) * (czz - l3) - cyz * cyz as c0, cyz * cxz - cxy * (czz - l3) as c1, cxy * cyz - (cyy - l3) * cxz as c2 from {tag}4),
{tag}6 as (select *, a0 * a0 + a1 * a1 + a2 * a2 as sa, b0 * b0 + b1 * b1 + b2 * b2 as sb, c0 * c0 + c1 * c1 + c2 * c2 as sc from {tag}5),
{tag}7 as (select *, sqrt(greatest(sa, sb, sc)) as s_, case when sa >= sb and sa >= sc then [a0, a1, a2] when sb >= sc then [b0, b1, b2] else [c0, c1, c2] end as v_ from {tag}6),
{tag}8 as (select *, case when s_ = 0 then null else v_[1] / s_ end as n0, case when s_ = 0 then null else v_[2] / s_ end as n1, case when s_ = 0 then null else v_[3] / s_ end as n2 from {tag}7),
{tag}9 as (select *, case when (case when abs(n0) >= abs(n1) and abs(n0) >= abs(n2) then n0 when abs(n1) >= abs(n2) then n1 else n2 end) < 0 then -1 else 1 end as g_ from {tag}8),
{tag} as (select {keep}, l1, l2, l3, n0 * g_ as nx, n1 * g_ as ny, n2 * g_ as nz from {tag}9)"""
