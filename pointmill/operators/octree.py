"""Searches in an octree: an index table of its nodes, descended level by level by all queries at once.

A node knows how many points it holds and their bounds. A query goes on to the children that its ball meets; a node inside
the ball is taken whole, without measuring its points. Levels of few nodes are broadcast (their rows are
counted in the index); deeper ones are joined on the node's number. At most twenty levels, and each is one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ, sq_distance
from pointmill.functions.tables import written
from pointmill.operators import spatial


@dataclass
class Octree:
    """`points` (nid, x, y, z, level, morton of the leaf), `nodes` (level, morton, n, leaf, bounds), nodes of each level."""

    points: DataFrame
    nodes: DataFrame
    widths: dict[int, int]


def build(df: DataFrame, leaf: int = 16, min_extent: float = 1e-4, id: str = "pid") -> Octree:
    """The index of a cloud, written. Points with a null coordinate are in no leaf; an empty cloud has no nodes."""
    whole = df.where(" and ".join(f"{c} is not null" for c in XYZ)).select(F.col(id).alias("nid"), *XYZ)
    points = written(spatial.octree_cells(whole, leaf, min_extent).select("nid", *XYZ, "level", "morton"), "octree")
    above = points.withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("level"))))
    code = F.expr("shiftright(morton, 3 * (level - _l))")
    bounds = [f(c).alias(f"{n}{c}") for c in XYZ for f, n in ((F.min, "low_"), (F.max, "high_"))]
    nodes = above.groupBy(F.col("_l").alias("level"), code.alias("morton")).agg(F.count("*").alias("n"), F.max(F.col("level") == F.col("_l")).alias("leaf"), *bounds)
    nodes = written(nodes, "nodes")
    return Octree(points, nodes, {r["level"]: r["n"] for r in nodes.groupBy("level").agg(F.count("*").alias("n")).collect()})  # a row a level


def _near_and_far() -> tuple[Column, Column]:
    """Squared distances of a query (_qx, _qy, _qz) to the nearest and the farthest place of a node's bounds."""
    zero, near, far = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for c in XYZ:
        low, high = F.col(f"_q{c}") - F.col(f"low_{c}"), F.col(f"_q{c}") - F.col(f"high_{c}")
        out = F.when(low < 0, low).when(high > 0, high).otherwise(zero)
        most = F.greatest(F.abs(low), F.abs(high))
        near, far = near + out * out, far + most * most
    return near, far


def _at(tree: Octree, level: int) -> DataFrame:
    nodes = tree.nodes.where(F.col("level") == level).drop("level").withColumnRenamed("morton", "_m")
    return F.broadcast(nodes) if tree.widths.get(level, 0) <= spatial.SMALL else nodes


def _descend(frontier: DataFrame, tree: Octree, keep: Sequence[str]) -> DataFrame | None:
    """(keep.., level, morton, n, near, far, whole) of the leaves that each query's ball (_r2, squared) meets."""
    near, far = _near_and_far()
    out, now = None, frontier.select(*keep, F.lit(0).cast("long").alias("morton"))
    for level in sorted(tree.widths):
        met = now.join(_at(tree, level), F.col("morton") == F.col("_m")).withColumn("near", near).withColumn("far", far).where(F.col("near") <= F.col("_r2"))
        met = written(met.select(*keep, F.lit(level).alias("level"), "morton", "n", "leaf", "near", "far", (F.col("far") <= F.col("_r2")).alias("whole")), "met")
        leaves = met.where("leaf").drop("leaf")
        out = leaves if out is None else out.unionByName(leaves)
        now = met.where("not leaf").select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.col("morton") * 8 + c)).alias("morton"))
    return out


def _queries(q: DataFrame, qid: str) -> DataFrame:
    return q.select(F.col(qid).alias("qid"), *[F.col(c).cast("double").alias(f"_q{c}") for c in XYZ])


_KEEP = ("qid", *(f"_q{c}" for c in XYZ), "_r2")


def candidates(q: DataFrame, tree: Octree, r: float, qid: str = "pid") -> DataFrame:
    """(qid, nid, sq, whole) of the points in leaves that meet the ball; those with `whole` are inside without a look at their distance."""
    found = _descend(_queries(q, qid).withColumn("_r2", F.lit(float(r) * float(r))), tree, _KEEP)
    sq = sq_distance([F.col(f"_q{c}") for c in XYZ], [F.col(c) for c in XYZ]).alias("sq")
    if found is None:
        return _queries(q, qid).where("false").select("qid", F.lit(None).cast("long").alias("nid"), F.lit(0.0).alias("sq"), F.lit(False).alias("whole"))
    return found.join(tree.points, ["level", "morton"]).select("qid", "nid", sq, "whole", "_r2").drop("_r2")


def radius(q: DataFrame, tree: Octree, r: float, qid: str = "pid") -> DataFrame:
    """(qid, nid, dist) of all pairs at most r apart."""
    return candidates(q, tree, r, qid).where(F.col("whole") | (F.col("sq") <= float(r) * float(r))).select("qid", "nid", F.sqrt("sq").alias("dist"))


def knn_candidates(q: DataFrame, tree: Octree, k: int, qid: str = "pid") -> DataFrame:
    """(qid, nid, dist) of points among which are the k nearest of each query.

    A query first goes down to a small node that holds k points: its farthest place bounds a ball with k points. Of the leaves that
    this ball meets, in the order of their farthest places, so many as hold k points bound a smaller one; only leaves
    that meet it are measured.
    """
    start = _queries(q, qid)
    if not tree.widths:
        return start.where("false").select("qid", F.lit(None).cast("long").alias("nid"), F.lit(0.0).alias("dist"))
    near, far = _near_and_far()
    here, homes, keep = start.withColumn("morton", F.lit(0).cast("long")), None, _KEEP[:-1]
    for level in sorted(tree.widths):
        met = here.join(_at(tree, level), F.col("morton") == F.col("_m")).withColumn("near", near).withColumn("far", far)
        met = met.where((F.col("n") >= k) | F.lit(level == 0))  # too few points in all: the root
        best = met.groupBy(*keep).agg(F.min_by(F.struct("morton", "far", "leaf"), F.struct("near", "far", "morton")).alias("b"))
        best = written(best.select(*keep, "b.morton", F.col("b.far").alias("_r2"), "b.leaf"), "homes")
        told = best.select(*keep, "_r2", F.lit(level).alias("_level"))
        homes = told if homes is None else homes.unionByName(told)
        here = best.where("not leaf").select(*keep, F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.col("morton") * 8 + c)).alias("morton"))
        if best.where("not leaf").isEmpty():
            break
    homes = homes.groupBy(*keep).agg(F.min("_r2").alias("_r2"))  # any of them is a bound
    found = _descend(homes, tree, _KEEP)
    w = Window.partitionBy("qid", *_KEEP[1:]).orderBy("far", "level", "morton").rowsBetween(Window.unboundedPreceding, -1)
    bound = found.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("_before") < k)
    bound = bound.groupBy("qid", *keep[1:]).agg(F.when(F.sum("n") >= k, F.max("far")).alias("_b"))
    on = [F.col("qid") == F.col("_i"), *[F.col(f"_q{c}").eqNullSafe(F.col(f"_p{c}")) for c in XYZ]]
    named = bound.select(F.col("qid").alias("_i"), *[F.col(f"_q{c}").alias(f"_p{c}") for c in XYZ], "_b")
    few = found.join(named, on).where(F.col("_b").isNull() | (F.col("near") <= F.col("_b")))
    sq = sq_distance([F.col(f"_q{c}") for c in XYZ], [F.col(c) for c in XYZ])
    return few.select("qid", *keep[1:], "level", "morton").join(tree.points, ["level", "morton"]).select("qid", "nid", F.sqrt(sq).alias("dist"))


def knn(q: DataFrame, tree: Octree, k: int, qid: str = "pid") -> DataFrame:
    """(qid, nid, dist, rank): the exact k nearest, ties by the smaller id; query ids must be unique."""
    return spatial.nearest(knn_candidates(q, tree, k, qid), k)
