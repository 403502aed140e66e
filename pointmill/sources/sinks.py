"""Writers of results; Spark's own writers wherever the format allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.sources import formats


def write_ply(points: DataFrame, folder: str, key: str = "frame", normals: bool = False, faces: DataFrame | None = None) -> DataFrame:
    """One PLY file for each key; (path, bytes) of what will be written when the frame is evaluated."""
    put = formats.ply_bytes(points, key, normals, faces).select(F.concat(F.col(key).cast("string"), F.lit(".ply")).alias("name"), "content")
    return formats.write_files(put, folder, "name", "content")


def write_object_bins(points: DataFrame, folder: str, key: Sequence[str] = ("cls", "frame", "obj")) -> DataFrame:
    """One file of f32 records for each object, named Class_frame_num.bin."""
    put = formats.as_bin(points, key).select(F.concat(F.concat_ws("_", *[F.col(k).cast("string") for k in key]), F.lit(".bin")).alias("name"), "content")
    return formats.write_files(put, folder, "name", "content")


def write_tree(df: DataFrame, folder: str, by: Sequence[str] = ("category", "split")) -> None:
    """Parquet under one folder for each category and split: the columnar form of a directory tree of clouds."""
    df.write.partitionBy(*by).parquet(folder)


def write_split(df: DataFrame, folder: str, name: str = "name", split: str = "split") -> None:
    """Lists of names, one folder for each split."""
    df.select(split, F.col(name).cast("string")).write.partitionBy(split).text(folder)


def write_labels(boxes: DataFrame, folder: str, detections: bool = False, key: str = "frame") -> DataFrame:
    """One label file for each frame, named by six digits."""
    put = formats.label_text(boxes, key, detections).select(F.concat(F.lpad(F.col(key).cast("string"), 6, "0"), F.lit(".txt")).alias("name"), "content")
    return formats.write_files(put, folder, "name", "content")


def write_clusters(labels: DataFrame, folder: str, id: str = "pid", label: str = "cluster") -> None:
    """One label a line in order of id: the parts' names give the order of the ranges."""
    labels.repartitionByRange(id).sortWithinPartitions(id).select(F.col(label).cast("string")).write.text(folder)


def write_registration(poses: DataFrame, folder: str) -> None:
    """CSV of idx1, idx2, t_x, t_y, t_z, q_w, q_x, q_y, q_z with a header."""
    poses.select("idx1", "idx2", "t_x", "t_y", "t_z", "q_w", "q_x", "q_y", "q_z").write.option("header", True).csv(folder)


def stats_table(curve: DataFrame, value: str = "precision") -> DataFrame:
    """(metric, cls, rank, easy, moderate, hard): a curve with a column for each difficulty."""
    names = ("easy", "moderate", "hard")
    return curve.groupBy("metric", "cls", "rank").agg(*[F.max(F.when(F.col("difficulty") == i, F.col(value))).alias(n) for i, n in enumerate(names)])


def write_stats(curve: DataFrame, folder: str, value: str = "precision") -> None:
    """The curve's table as text, a folder for each metric and class: one line a rank with its easy, moderate and hard values."""
    rows = stats_table(curve, value)
    line = F.concat_ws(" ", F.col("rank").cast("string"), *[F.coalesce(F.col(n).cast("string"), F.lit("nan")) for n in ("easy", "moderate", "hard")])
    rows.select("metric", "cls", line.alias("value")).write.partitionBy("metric", "cls").text(folder)


def read_stats(spark: SparkSession, folder: str) -> DataFrame:
    """What write_stats() wrote; a missing value is null."""
    part = F.split("value", " ")
    number = lambda i: F.when(part[i] != "nan", part[i].cast("double"))
    return spark.read.text(folder).select("metric", "cls", part[0].cast("int").alias("rank"), *[number(i + 1).alias(n) for i, n in enumerate(("easy", "moderate", "hard"))])


def save_cells(df: DataFrame, folder: str, edge: float, cols: Sequence[str] = ("x", "y", "z"), parts: int = 8) -> None:
    """A spatial index on disk: points with their cells, cells of one hash together and in order."""
    cells = [F.floor(F.col(c) / edge).cast("long").alias(f"c{c}") for c in cols]
    names = [f"c{c}" for c in cols]
    df.select("*", *cells).repartition(parts, *names).sortWithinPartitions(*names).write.parquet(folder)


def load_cells(spark: SparkSession, folder: str, low: Sequence[float], high: Sequence[float], edge: float, cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The points of a box: the cells' ranges are pushed to the scan, the box decides."""
    import math

    df = spark.read.parquet(folder)
    for c, a, b in zip(cols, low, high, strict=True):
        df = df.where(F.col(f"c{c}").between(math.floor(a / edge), math.floor(b / edge)) & F.col(c).between(a, b))
    return df.drop(*[f"c{c}" for c in cols])
