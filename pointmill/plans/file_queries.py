"""Queries that write files and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pointmill.functions.tables import shared_dir
from pointmill.operators import cluster, evaluate
from pointmill.plans import views
from pointmill.plans.registry import query
from pointmill.sources import formats, sinks


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_files(spark, df) -> str:
    """(name, content) rows as files; the folder."""
    out = folder(spark, "text")
    formats.write_files(df, out, "name", "content").count()
    return out


def joined(spark, df, cols, sep=",", head=""):
    """A text file for each frame of rows with the columns in twelve digits."""
    line = F.concat_ws(sep, *[F.format_string("%.12f", c) for c in cols])
    rows = df.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("pid", line.alias("t")))).alias("r"))
    text = F.concat(F.lit(head), F.array_join(F.transform("r", lambda s: s["t"]), "\n"))
    return text_files(spark, rows.select(F.concat(F.lit("f"), F.col("frame").cast("string"), F.lit(".txt")).alias("name"), text.alias("content")))


_PID = "(row_number() over (partition by frame order by pid) - 1)::bigint as pid"


@query("scan_csv_2d", f"select 'f' || frame as frame, {_PID}, round(x, 4) as x, round(y, 4) as y from pts3")
def scan_csv_2d(spark, sf):
    return formats.read_csv(spark, joined(spark, views.pts3(spark, sf), "xy"), ("x", "y")).select("frame", "pid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("scan_txt_normals", f"select 'f' || frame as frame, {_PID}, round(z, 4) as z, round(-x, 4) as nx, round(-z, 4) as nz from pts3")
def scan_txt_normals(spark, sf):
    p = views.pts3(spark, sf).select("*", *[(-F.col(c)).alias(f"n{c}") for c in "xyz"])
    names = ("x", "y", "z", "nx", "ny", "nz")
    return formats.read_csv(spark, joined(spark, p, names), names).select("frame", "pid", *[F.round(c, 4).alias(c) for c in ("z", "nx", "nz")])


@query("scan_pairs", "select pid::int as target, frame as source, round(x, 4) as t_x, round(z, 4) as q_w from (select *, row_number() over (partition by frame order by pid) as r from pts3) where r > 3")
def scan_pairs(spark, sf):
    p = views.pts3(spark, sf).select("frame", "pid", F.col("pid").cast("double").alias("a"), F.col("frame").cast("double").alias("b"), "x", "y", "z")
    path = joined(spark, p, ("a", "b", "x", "y", "z", "z", "x", "x", "x"), head="idx1,idx2,t_x,t_y,t_z,q_w,q_x,q_y,q_z\n")
    return formats.read_pairs(spark, path, skip=3).select("target", "source", F.round("t_x", 4).alias("t_x"), F.round("q_w", 4).alias("q_w"))


@query("scan_calib", "select 'f' || frame as frame, round(cos(frame), 4) as r00, round(0.0::double - sin(frame), 4) as r01, 0.1::double as tx, 0.3::double as tz from (select distinct frame from pts3)")
def scan_calib(spark, sf):
    a = F.col("frame").cast("double")
    numbers = [F.cos(a), F.lit(0.0) - F.sin(a), F.lit(0.0), F.lit(0.1), F.sin(a), F.cos(a), F.lit(0.0), F.lit(0.2), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.3)]
    row = F.concat_ws(" ", F.lit("Tr_velo_to_cam:"), *[F.format_string("%.12f", n) for n in numbers])
    text = F.concat(F.lit("P0: 1\nP1: 1\nP2: 1\nP3: 1\nR0: 1\n"), row, F.lit("\n"))
    path = text_files(spark, views.pts3(spark, sf).select("frame").distinct().select(F.concat(F.lit("f"), F.col("frame").cast("string"), F.lit(".txt")).alias("name"), text.alias("content")))
    return formats.read_calibration(spark, path).select("frame", *[F.round(c, 4).alias(c) for c in ("r00", "r01", "tx", "tz")])


@query("scan_depth_quad", "select 's' || frame as name, '/a/s' || frame || '_image.png' as image, '/b/s' || frame || '_depth.png' as depth from (select distinct frame from pts3) where frame % 2 = 0")
def scan_depth_quad(spark, sf):
    f = views.pts3(spark, sf).select(F.col("frame").cast("string").alias("f"), "frame").distinct()
    path = lambda d, folder_, kind, end: d.select(F.concat(F.lit(f"/{folder_}/s"), "f", F.lit(f"_{kind}.{end}")).alias("path"))
    return formats.associated(path(f, "a", "image", "png"), path(f.where("frame % 2 = 0"), "b", "depth", "png"), path(f, "c", "camera", "txt")).select("name", "image", "depth")


@query("sink_ply", "select frame::varchar as frame, count(*) as n, round(sum(x::float::double), 3) as sx, round(sum(-z::float::double), 3) as snz from pts3 group by frame")
def sink_ply(spark, sf):
    p = views.pts3(spark, sf).select("*", *[(-F.col(c)).alias(f"n{c}") for c in "xyz"])
    faces = p.groupBy("frame").agg(F.lit(0).cast("long").alias("fid"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("v"))
    out = folder(spark, "ply")
    sinks.write_ply(p, out, normals=True, faces=faces).count()
    return formats.read_ply(spark, out, ("x", "nz")).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx"), F.round(F.sum("nz"), 3).alias("snz"))


@query("sink_object_bin", "select 'Car_' || frame || '_0' as frame, (row_number() over (partition by frame order by pid) - 1)::bigint as pid, 'Car' as cls, round(x::float::double, 5) as x, round(y::float::double, 5) as y, round(z::float::double, 5) as z from pts3")
def sink_object_bin(spark, sf):
    out = folder(spark, "objects")
    p = views.pts3(spark, sf).select(F.lit("Car").alias("cls"), "frame", F.lit(0).alias("obj"), "pid", "x", "y", "z")
    sinks.write_object_bins(p, out).count()
    return formats.read_object_bin(spark, out).select("frame", "pid", "cls", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("sink_tree_convert", "select case when frame < 5 then 'chair' else 'desk' end as category, case when pid % 3 = 0 then 'test' else 'train' end as split, count(*) as n from pts3 group by 1, 2")
def sink_tree_convert(spark, sf):
    out = folder(spark, "tree")
    p = views.pts3(spark, sf).withColumn("category", F.when(F.col("frame") < 5, "chair").otherwise("desk")).withColumn("split", F.when(F.col("pid") % 3 == 0, "test").otherwise("train"))
    sinks.write_tree(p, out)
    return spark.read.parquet(out).groupBy("category", "split").agg(F.count("*").alias("n"))


@query("sink_split", "select split, type || '_' || ord as value from (select type, ord, case when row_number() over (partition by type order by ord) <= ceil(count(*) over (partition by type) * 0.7) then 'train' else 'test' end as split from gt_boxes)")
def sink_split(spark, sf):
    out = folder(spark, "split")
    sinks.write_split(evaluate.split(views.gt_boxes(spark, sf)).withColumn("name", F.concat_ws("_", "type", "ord")), out)
    return spark.read.text(out).select("split", "value")


@query("sink_labels", "select frame, count(*) as n, round(sum(case when m > pi() then round(m - 2 * pi(), 2) else round(m, 2) end), 1) as alpha from (select lpad(frame::varchar, 6, '0') as frame, alpha - 2 * pi() * floor(alpha / (2 * pi())) as m from gt_boxes) group by frame")
def sink_labels(spark, sf):
    out = folder(spark, "labels")
    sinks.write_labels(views.with_3d(views.gt_boxes(spark, sf)), out).count()
    return formats.read_labels(spark, out).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("alpha"), 1).alias("alpha"))


@query("sink_reg", "select pid::int as target, frame as source, round(y, 5) as t_y from pts3")
def sink_reg(spark, sf):
    out = folder(spark, "poses")
    p = views.pts3(spark, sf)
    sinks.write_registration(p.select(F.col("pid").alias("idx1"), F.col("frame").alias("idx2"), F.col("x").alias("t_x"), F.col("y").alias("t_y"), F.col("z").alias("t_z"), *[F.lit(0.5).alias(q) for q in ("q_w", "q_x", "q_y", "q_z")]), out)
    return formats.read_pairs(spark, out).select("target", "source", F.round("t_y", 5).alias("t_y"))


@query("sink_stats", "select 'image' as metric, type as cls, frame as rank, max(score) filter (where ord % 3 = 0) as easy, max(score) filter (where ord % 3 = 1) as moderate, max(score) filter (where ord % 3 = 2) as hard from det_boxes group by type, frame")
def sink_stats(spark, sf):
    d = views.det_boxes(spark, sf).select(F.lit("image").alias("metric"), F.col("type").alias("cls"), F.col("frame").alias("rank"), (F.col("ord") % 3).alias("difficulty"), F.col("score").alias("precision"))
    out = folder(spark, "stats")
    sinks.write_stats(d, out)
    return sinks.read_stats(spark, out)


@query("nano_save_load", "select pid, x from pts3 where x between -0.5 and 1.0 and y between -1.0 and 0.75 and z between -2.0 and 2.0")
def nano_save_load(spark, sf):
    out = folder(spark, "cells")
    sinks.save_cells(views.pts3(spark, sf), out, 0.5)
    return sinks.load_cells(spark, out, (-0.5, -1.0, -2.0), (1.0, 0.75, 2.0), 0.5).select("pid", "x")


@query("comparison_count", "select count(*) as candidates from (select a.pid from pts3 a join pts3 b on abs(floor(a.x / (0.7::double * (1 + 1e-9::double))) - floor(b.x / (0.7::double * (1 + 1e-9::double)))) <= 1 and abs(floor(a.y / (0.7::double * (1 + 1e-9::double))) - floor(b.y / (0.7::double * (1 + 1e-9::double)))) <= 1 and abs(floor(a.z / (0.7::double * (1 + 1e-9::double))) - floor(b.z / (0.7::double * (1 + 1e-9::double)))) <= 1)")
def comparison_count(spark, sf):
    from pointmill.operators import spatial

    p = views.pts3(spark, sf)
    return spatial.candidates(p, p, 0.7).agg(F.count("*").alias("candidates"))


@query("mean_shift")
def mean_shift(spark, sf):
    return cluster.mean_shift(views.pts3(spark, sf), 1.5)


@query("power_iteration")
def power_iteration(spark, sf):
    return cluster.power_iteration(cluster.knn_graph(views.pts3(spark, sf), 10), 3)
