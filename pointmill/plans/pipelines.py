"""Whole pipelines: objects in front of the ground, and a dataset of labelled objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.tables import written
from pointmill.operators import boxes, cluster, filters, ground, linalg

SEGMENTS = ((-150, -20), (-20, 20), (20, 150))


def foreground_objects(points: DataFrame, eps: float = 3.0, min_points: int = 4, lpr: int = 10_000, ground_z: float = -1.73) -> DataFrame:
    """(frame, cluster, verdict, n, bounds): crop, ground, density clusters, rules, boxes; all frames at once."""
    kept = filters.segment(filters.crop(points, y=(-15, 30)), SEGMENTS)
    marked = written(ground.svd(kept, lpr=lpr), "ground")
    front = marked.where("not is_ground").select("frame", "pid", "x", "y", "z")
    labels = cluster.dbscan(front, eps, min_points, key=("frame",)).where("cluster <> -1")
    objects = written(front.join(labels.select("pid", "cluster"), "pid"), "objects")
    verdicts = cluster.rules(objects, ground_z).select("frame", "cluster", "verdict")
    return linalg.stats(objects, ("frame", "cluster")).join(verdicts, ["frame", "cluster"]).select("frame", "cluster", "verdict", "n", "minx", "miny", "minz", "maxx", "maxy", "maxz")


def build_objects(points: DataFrame, labels: DataFrame, least: int = 1, eps: float = 3.0, min_points: int = 4, background: int = 8, background_least: int = 4) -> DataFrame:
    """(frame, obj, cls, pid): points of labelled boxes; of what remains, clusters over the ground as DontCare.

    Every `background`-th cluster with more than background_least points is kept.
    """
    inside = written(boxes.points_in(points, labels), "inside")
    named = inside.join(labels.select("frame", F.col("ord").alias("box"), F.col("type").alias("cls")), ["frame", "box"]).select("frame", F.col("box").alias("obj"), "cls", "pid")
    sizes = named.groupBy("frame", "obj").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("frame", "obj")
    rest = points.join(inside.select("pid").distinct(), "pid", "left_anti")
    marked = written(ground.svd(filters.segment(rest, SEGMENTS)), "ground")
    front = marked.where("not is_ground").select("frame", "pid", "x", "y", "z")
    found = cluster.dbscan(front, eps, min_points, key=("frame",)).where(F.col("cluster") >= 0)
    large = found.groupBy("frame", "cluster").agg(F.count("*").alias("_n")).where((F.col("_n") > background_least) & (F.col("cluster") % background == 0))
    other = found.join(large, ["frame", "cluster"], "left_semi").select("frame", F.col("cluster").alias("obj"), F.lit("DontCare").alias("cls"), "pid")
    return named.join(sizes, ["frame", "obj"], "left_semi").unionByName(other)
