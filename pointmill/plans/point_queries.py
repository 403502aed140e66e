"""Queries over points: filters, neighbour joins, aggregates, normals, ground."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pointmill.functions import geometry
from pointmill.operators import filters, ground, linalg, octree, spatial
from pointmill.plans import views
from pointmill.plans.registry import query

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
KEYS = ["k1", "k2", "k3", "k4", "k5", "frame"]
_K = "k1, k2, k3, k4, k5, frame"
#: A fixed rotation of 10 degrees about z with a shift.
ANGLE = math.radians(10)
ROT = [[math.cos(ANGLE), -math.sin(ANGLE), 0.0], [math.sin(ANGLE), math.cos(ANGLE), 0.0], [0.0, 0.0, 1.0]]
SHIFT = [0.1, -0.05, 0.02]
_C, _S = repr(math.cos(ANGLE)), repr(math.sin(ANGLE))


# --- filters and scalar geometry ----------------------------------------------------


@query("filter_range", f"select {_K}, x, y, z from pts_big where y > 10 and y < 30 and x > 5")
def filter_range(spark, sf):
    return filters.crop(views.pts_big(spark, sf), y=(10, 30), x=(5, None)).select(*KEYS, "x", "y", "z")


@query("filter_below_z", "select pid, frame, x, y, z from scan where z < -1.23::double")
def filter_below_z(spark, sf):
    return filters.crop(views.scan(spark, sf), z=(None, -1.73 + 0.5))


@query("segment_x", "select pid, case when x > -150 and x < -20 then 0 when x > -20 and x < 20 then 1 else 2 end as seg from scan where (x > -150 and x < -20) or (x > -20 and x < 20) or (x > 20 and x < 150)")
def segment_x(spark, sf):
    return filters.segment(views.scan(spark, sf), [(-150, -20), (-20, 20), (20, 150)]).select("pid", "seg")


@query(
    "segment_uniform",
    """with b as (select min(x) as a, (max(x) - min(x)) / 5 as s from pts_big), g as (select p.*, b.a + i * b.s as lo, b.a + (i + 1) * b.s as hi, i::int as seg from pts_big p, b, range(5) r(i))
    select frame, seg, count(*) as n from g where x > lo and x < hi group by frame, seg""",
)
def segment_uniform(spark, sf):
    return filters.segment_uniform(views.pts_big(spark, sf), 5).groupBy("frame", "seg").agg(F.count("*").alias("n"))


@query("segment_half", "select pid, case when x >= 0 then 0 else 1 end as seg from pts3")
def segment_half(spark, sf):
    return filters.segment_half(views.pts3(spark, sf)).select("pid", "seg")


@query("plane_dist", f"select {_K}, round(abs(0.6 * x + 0.8 * z - 5), 6) as dist from pts_big where abs(0.6 * x + 0.8 * z - 5) < 2")
def plane_dist(spark, sf):
    d = linalg.plane_distance([F.lit(0.6), F.lit(0.0), F.lit(0.8)], F.lit(-5.0))
    return views.pts_big(spark, sf).where(d < 2).select(*KEYS, F.round(d, 6).alias("dist"))


@query(
    "plane_from_3pts",
    """with r as (select frame, x, y, z, row_number() over (partition by frame order by pid) as i from pts3), t as (
      select a.frame, a.x as ax, a.y as ay, a.z as az, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz
      from r a join r b on a.frame = b.frame and b.i = 2 join r c on a.frame = c.frame and c.i = 3 where a.i = 1), n as (
      select *, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from t), s as (select *, sqrt(nx * nx + ny * ny + nz * nz) as s from n)
    select frame, round(nx / s, 6) as a, round(ny / s, 6) as b, round(nz / s, 6) as c, round(-(nx / s * ax + ny / s * ay + nz / s * az), 6) as d from s""",
)
def plane_from_3pts(spark, sf):
    from pyspark.sql import Window

    r = views.pts3(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("frame").orderBy("pid"))).where("i <= 3")
    three = r.groupBy("frame").agg(*[F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in (1, 2, 3) for c in "xyz"])
    abcd = geometry.plane_through([[F.col(f"{c}{i}") for c in "xyz"] for i in (1, 2, 3)])
    return three.select("frame", *[F.round(v, 6).alias(n) for v, n in zip(abcd, "abcd", strict=True)])


@query("rigid_transform", f"select pid, round({_C} * x - {_S} * y + 0.1, 6) as x, round({_S} * x + {_C} * y - 0.05, 6) as y, round(z + 0.02, 6) as z from pts3")
def rigid_transform(spark, sf):
    return views.pts3(spark, sf).select("pid", *geometry.transformed(ROT, SHIFT)).select("pid", *R6("x", "y", "z"))


@query("normal_transform", f"select pid, round({_C} * x - {_S} * y, 6) as x, round({_S} * x + {_C} * y, 6) as y, round(z, 6) as z from pts3")
def normal_transform(spark, sf):
    return views.pts3(spark, sf).select("pid", *geometry.transformed(ROT, [0, 0, 0])).select("pid", *R6("x", "y", "z"))


@query("quat_from_R", "select ord, round(cos(alpha / 2) * sign(cos(alpha / 2)), 6) as qw, 0.0::double as qx, 0.0::double as qy, round(sin(alpha / 2) * sign(cos(alpha / 2)), 6) as qz from gt_boxes where abs(alpha) < 2")
def quat_from_R(spark, sf):
    c, s, o, i = F.cos("alpha"), F.sin("alpha"), F.lit(0.0), F.lit(1.0)
    q = geometry.quaternion([[c, -s, o], [s, c, o], [o, o, i]])
    return views.gt_boxes(spark, sf).where("abs(alpha) < 2").select("ord", *[F.round(v, 6).alias(n) for v, n in zip(q, ("qw", "qx", "qy", "qz"), strict=True)])


@query("wrap_to_pi", "select ord, round(case when m > pi() then m - 2 * pi() else m end, 6) as angle from (select ord, a - 2 * pi() * floor(a / (2 * pi())) as m from (select ord, alpha * 5 as a from gt_boxes))")
def wrap_to_pi(spark, sf):
    return views.gt_boxes(spark, sf).select("ord", F.round(geometry.wrap_to_pi(F.col("alpha") * 5), 6).alias("angle"))


_PIXEL = """px as (select pid, frame, x, y, z, 85 - (floor(atan2(z, sqrt(x * x + y * y)) / (0.7 * 3.141592653589793 / 180)) + 43) as prow, 514 - (floor(atan2(y, x) / (0.7 * 3.141592653589793 / 180)) + 258) as pcol from pts3)"""


@query("spherical_pixel", f"with {_PIXEL} select frame, pid, prow::int as prow, pcol::int as pcol from px")
def spherical_pixel(spark, sf):
    return ground.pixel_of(views.pts3(spark, sf))


@query(
    "range_image",
    f"""with {_PIXEL}, one as (select frame, prow, pcol, max(pid) as pid, count(*) as n from px group by all)
    select o.frame, dense_rank() over (partition by o.frame order by o.prow)::int - 1 as row, dense_rank() over (partition by o.frame order by o.pcol)::int - 1 as col, o.pid, o.n, round(sqrt(p.x * p.x + p.y * p.y + p.z * p.z), 6) as range
    from one o join pts3 p using (pid)""",
)
def range_image(spark, sf):
    return ground.range_image(views.pts3(spark, sf)).select("frame", "row", "col", "pid", "n", F.round("range", 6).alias("range"))


@query("center_normalize", "select pid, frame, round(x - avg(x) over w, 6) as x, round(y - avg(y) over w, 6) as y, round(z - avg(z) over w, 6) as z from pts3 window w as (partition by frame)")
def center_normalize(spark, sf):
    return filters.normalize(views.pts3(spark, sf), ("frame",)).select("pid", "frame", *R6("x", "y", "z"))


@query(
    "center_scale_normalize",
    """with c as (select pid, frame, x - avg(x) over w as x, y - avg(y) over w as y, z - avg(z) over w as z from pts3 window w as (partition by frame)), r as (select *, max(sqrt(x * x + y * y + z * z)) over (partition by frame) as r from c)
    select pid, frame, round(x / r, 6) as x, round(y / r, 6) as y, round(z / r, 6) as z from r""",
)
def center_scale_normalize(spark, sf):
    return filters.normalize(views.pts3(spark, sf), ("frame",), "unit").select("pid", "frame", *R6("x", "y", "z"))


@query("standard_scale", "select pid, round((x - avg(x) over ()) / stddev_pop(x) over (), 6) as x, round((y - avg(y) over ()) / stddev_pop(y) over (), 6) as y, round((z - avg(z) over ()) / stddev_pop(z) over (), 6) as z from pts3")
def standard_scale(spark, sf):
    return filters.normalize(views.pts3(spark, sf), (), "std").select("pid", *R6("x", "y", "z"))


_PX = "px as (select cast(l_orderkey % 7 as int) as frame, cast(l_partkey % 40 as int) as u, cast(l_suppkey % 30 as int) as v, cast(min(l_quantity) as double) as depth from lineitem group by 1, 2, 3)"


def pixels(spark, sf):
    li = views.table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 7).cast("int").alias("frame"), (F.col("l_partkey") % 40).cast("int").alias("u"), (F.col("l_suppkey") % 30).cast("int").alias("v")).agg(F.min("l_quantity").cast("double").alias("depth"))


@query("pinhole_backproject", f"with {_PX} select frame, u, v, round((u - 20) * (depth / 10) / 25, 6) as x, round((v - 15) * (depth / 10) / 25, 6) as y, round(depth / 10, 6) as z from px where depth > 0 and depth / 10 < 4")
def pinhole_backproject(spark, sf):
    return filters.backproject(pixels(spark, sf), 25.0, 25.0, 20.0, 15.0, scale=10.0, trunc=4.0).select("frame", "u", "v", *R6("x", "y", "z"))


@query("gaussian_weight", "select pid, round(exp(-(x * x) / (2 * 1.5 * 1.5)), 6) as w from pts3")
def gaussian_weight(spark, sf):
    return views.pts3(spark, sf).select("pid", F.round(geometry.gaussian(F.col("x"), 1.5), 6).alias("w"))


@query(
    "bilateral_window",
    f"""with {_PX}, j as (select a.frame, a.u, a.v, b.depth, exp(-(power(b.u - a.u, 2) + power(b.v - a.v, 2)) / 2) * exp(-power(b.depth - a.depth, 2) / (2 * 25)) as w from px a join px b on a.frame = b.frame and abs(a.u - b.u) <= 1 and abs(a.v - b.v) <= 1)
    select frame, u, v, round(sum(w * depth) / sum(w), 6) as depth from j group by frame, u, v""",
)
def bilateral_window(spark, sf):
    return filters.bilateral(pixels(spark, sf), radius=1, sigma_space=1.0, sigma_value=5.0).select("frame", "u", "v", F.round("depth", 6).alias("depth"))


@query(
    "morph_closing",
    f"""with {_PX}, up as (select frame, u + i as u, v + j as v, max(depth) as depth from px, range(-1, 2) a(i), range(-1, 2) b(j) group by all),
    down as (select frame, u + i as u, v + j as v, case when count(*) < 9 then least(-1, min(depth)) else min(depth) end as depth from up, range(-1, 2) a(i), range(-1, 2) b(j) group by all)
    select px.frame, px.u, px.v, down.depth::double as depth from px join down using (frame, u, v)""",
)
def morph_closing(spark, sf):
    return filters.closing(pixels(spark, sf))


@query("zero_count", f"with {_PX} select depth as value, count(*) as n from px group by 1 order by 1 limit 1")
def zero_count(spark, sf):
    return filters.zero_count(pixels(spark, sf), "depth")


@query("string_ops", "select ord, lower(type) = 'car' as is_car, split_part(type || '_' || lpad(ord::varchar, 6, '0') || '.bin', '_', 1) as cls, regexp_replace(lpad(ord::varchar, 6, '0') || '.bin', '\\.bin$', '') as stem, lpad(frame::varchar, 6, '0') || '.txt' as file from gt_boxes")
def string_ops(spark, sf):
    name = F.concat(F.lpad(F.col("ord").cast("string"), 6, "0"), F.lit(".bin"))
    return views.gt_boxes(spark, sf).select("ord", (F.lower("type") == "car").alias("is_car"), F.split_part(F.concat(F.col("type"), F.lit("_"), name), F.lit("_"), F.lit(1)).alias("cls"), F.regexp_replace(name, "\\.bin$", "").alias("stem"), F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".txt")).alias("file"))


@query("math_ops", "select pid, round(sqrt(abs(x)), 6) as a, round(power(y, 2), 6) as b, round(atan2(y, x), 6) as c, floor(z)::bigint as d, ceil(z)::bigint as e, (pid % 7)::bigint as f, (pid | 5)::bigint as g, round(asin(greatest(-1, least(1, x / 10))), 6) as h from pts3")
def math_ops(spark, sf):
    c = F.col
    return views.pts3(spark, sf).select("pid", F.round(F.sqrt(F.abs("x")), 6).alias("a"), F.round(F.pow("y", F.lit(2)), 6).alias("b"), F.round(F.atan2("y", "x"), 6).alias("c"), F.floor("z").alias("d"), F.ceil("z").alias("e"), (c("pid") % 7).alias("f"), c("pid").bitwiseOR(F.lit(5)).cast("long").alias("g"), F.round(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c("x") / 10))), 6).alias("h"))


@query(
    "array_ops",
    """with a as (select frame, list(x order by pid) as xs, list(distinct floor(y)) as ys from pts3 group by frame)
    select frame, len(xs)::int as n, round(list_sum(xs), 4) as total, list_min(ys)::bigint as low, len(ys)::int as cells, round(xs[len(xs)], 6) as last, len(list_filter(xs, lambda v: v > 0))::int as positive, list_contains(ys, 0) as has_zero from a""",
)
def array_ops(spark, sf):
    # a frame's points are gathered, as an object's points are in one record
    a = views.pts3(spark, sf).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("pid", "x"))).alias("_p"), F.collect_set(F.floor("y")).alias("ys")).withColumn("xs", F.transform("_p", lambda p: p["x"]))
    return a.select(
        "frame", F.size("xs").alias("n"), F.round(F.aggregate("xs", F.lit(0.0), lambda t, v: t + v), 4).alias("total"), F.array_min("ys").alias("low"), F.size("ys").alias("cells"),
        F.round(F.element_at("xs", -1), 6).alias("last"), F.size(F.filter("xs", lambda v: v > 0)).alias("positive"), F.array_contains("ys", F.lit(0).cast("long")).alias("has_zero"),
    )


# --- neighbour joins ------------------------------------------------------------------

_ALL = "select a.pid as qid, b.pid as nid, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as dist from pts3 a, pts3 b"


def _knn_sql(k: int, where: str = "true") -> str:
    return f"select qid, nid, round(dist, 6) as dist, rank::int as rank from (select *, row_number() over (partition by qid order by dist, nid) as rank from ({_ALL}) where {where}) where rank <= {k}"


def _told(df):
    return df.select("qid", "nid", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("knn_brute", _knn_sql(8))
def knn_brute(spark, sf):
    p = views.pts3(spark, sf)
    return _told(spatial.knn_brute(p, p, 8))


@query("knn_kdtree", _knn_sql(8))
def knn_kdtree(spark, sf):
    p = views.pts3(spark, sf)
    return _told(spatial.knn_join(p, p, 8))


@query("knn_octree", _knn_sql(5))
def knn_octree(spark, sf):
    p = views.pts3(spark, sf)
    return _told(octree.knn(p, octree.build(p, 16, 1e-3), 5))


@query("knn_per_frame", "select frame, qid, nid, round(dist, 6) as dist, rank::int as rank from (select *, row_number() over (partition by frame, qid order by dist, nid) as rank from (select a.frame, a.pid as qid, b.pid as nid, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as dist from pts3 a join pts3 b on a.frame = b.frame)) where rank <= 4")
def knn_per_frame(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.knn_join(p, p, 4, key=("frame",)).select("frame", "qid", "nid", F.round("dist", 6).alias("dist"), F.col("rank").cast("int").alias("rank"))


@query("hybrid_knn_radius", _knn_sql(10, "dist <= 0.8"))
def hybrid_knn_radius(spark, sf):
    p = views.pts3(spark, sf)
    return _told(spatial.knn_within(p, p, 10, 0.8))


@query("radius_kdtree", f"select qid, nid, round(dist, 6) as dist from ({_ALL}) where dist <= 0.5")
def radius_kdtree(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.radius_join(p, p, 0.5).select("qid", "nid", F.round("dist", 6).alias("dist"))


@query("radius_octree", f"select qid, count(*) as n, round(max(dist), 6) as far from ({_ALL}) where dist <= 0.9 group by qid")
def radius_octree(spark, sf):
    p = views.pts3(spark, sf)
    return octree.radius(p, octree.build(p, 16, 1e-3), 0.9).groupBy("qid").agg(F.count("*").alias("n"), F.round(F.max("dist"), 6).alias("far"))


@query("nano_radius", f"select qid, nid, round(dist, 6) as dist from ({_ALL}) where dist * dist < 0.3")
def nano_radius(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.radius_join(p, p, math.sqrt(0.3), strict=True).select("qid", "nid", F.round("dist", 6).alias("dist"))


@query("knn_bst_1d", "select qid, nid, round(dist, 6) as dist, rank::int as rank from (select *, row_number() over (partition by qid order by dist, nid) as rank from (select a.pid as qid, b.pid as nid, abs(a.x - b.x) as dist from pts3 a, pts3 b)) where rank <= 3")
def knn_bst_1d(spark, sf):
    p = views.pts3(spark, sf)
    return _told(spatial.knn_1d(p, p, 3))


@query("radius_bst_1d", "select a.pid as qid, b.pid as nid, round(abs(a.x - b.x), 6) as dist from pts3 a, pts3 b where abs(a.x - b.x) <= 0.01")
def radius_bst_1d(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.radius_1d(p, p, 0.01).select("qid", "nid", F.round("dist", 6).alias("dist"))


@query("bst_point_lookup", "select k.key as pid, p.frame, p.x from (select distinct l_partkey % 300 as key from lineitem where l_orderkey % 50 = 0) k join pts3 p on p.pid = k.key")
def bst_point_lookup(spark, sf):
    keys = views.table(spark, sf, "lineitem").where("l_orderkey % 50 = 0").select((F.col("l_partkey") % 300).alias("pid")).distinct()
    return spatial.lookup(keys, views.pts3(spark, sf), "pid").select("pid", "frame", "x")


@query("metric_adaptors", "select qid, round(l1, 6) as l1, round(l2, 6) as l2, round(so2, 6) as so2 from (select a.pid as qid, min(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)) as l1, min(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as l2, min(abs(case when d > pi() then d - 2 * pi() when d < -pi() then d + 2 * pi() else d end)) as so2 from pts3 a, pts3 b, (select 0) , lateral (select b.x / 5 - a.x / 5 as d) where a.frame = b.frame and a.pid <> b.pid group by a.pid)")
def metric_adaptors(spark, sf):
    p = views.pts3(spark, sf)
    a = p.select("frame", F.col("pid").alias("qid"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = p.select("frame", F.col("pid").alias("nid"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    q, n = [F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"]
    j = a.join(b, "frame").where("qid <> nid")
    return j.groupBy("qid").agg(F.round(F.min(geometry.metric_distance(q, n, "l1")), 6).alias("l1"), F.round(F.min(geometry.metric_distance(q, n)), 6).alias("l2"), F.round(F.min(geometry.metric_distance([q[0] / 5], [n[0] / 5], "so2")), 6).alias("so2"))


@query("nano_dynamic_index", "with base as (select * from pts3 where pid % 2 = 0 union all select * from pts3 where pid % 2 = 1), live as (select * from base where pid % 10 <> 0) select frame, count(*) as n, round(sum(x), 4) as sx from live group by frame")
def nano_dynamic_index(spark, sf):
    p = views.pts3(spark, sf)
    live = spatial.with_delta(p.where("pid % 2 = 0"), p.where("pid % 2 = 1"), p.where("pid % 10 = 0"))
    return live.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"))


@query("nn_1", "select pid, k, round(d, 6) as sqdist from (select p.pid, c.k, d, row_number() over (partition by p.pid order by d, c.k) as r from pts3 p, (values (0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.5), (2, -1.0, 0.5, -1.0)) c(k, x, y, z), lateral (select power(p.x - c.x::double, 2) + power(p.y - c.y::double, 2) + power(p.z - c.z::double, 2) as d)) where r = 1")
def nn_1(spark, sf):
    from pointmill.operators import cluster

    centres = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.5), (2, -1.0, 0.5, -1.0)], "k int, x double, y double, z double")
    return cluster.assign(views.pts3(spark, sf), centres).select("pid", "k", F.round("sqdist", 6).alias("sqdist"))


_VEC = "select a.pid as qid, b.pid as nid, sqrt(list_sum(list_transform(range(1, 65), lambda i: power(a.vec[i]::double - b.vec[i]::double, 2)))) as dist from vec64 a, vec64 b where {}"


@query("nn_desc", f"select qid, nid, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, nid) as r from ({_VEC.format('a.pid % 2 = 0 and b.pid % 2 = 1')})) where r = 1")
def nn_desc(spark, sf):
    v = views.vec64(spark, sf)
    return spatial.knn_vectors(v.where("pid % 2 = 0"), v.where("pid % 2 = 1"), 1).select("qid", "nid", F.round("dist", 6).alias("dist"))


_NN = f"""both_ as ({_VEC.format('a.pid % 2 = 0 and b.pid % 2 = 1')}), st as (select qid as s, nid as t, dist from (select *, row_number() over (partition by qid order by dist, nid) as r from both_) where r = 1),
ts as (select qid as s, nid as t, dist from (select *, row_number() over (partition by nid order by dist, qid) as r from both_) where r = 1)"""


@query("mutual_nn_join", f"with {_NN}, m as (select st.* from st join ts using (s, t)) select s, t, round(dist, 6) as dist from (select *, row_number() over (order by dist, s, t) as r, count(*) over () as n from m) where r <= floor(n * 0.5)")
def mutual_nn_join(spark, sf):
    from pointmill.operators import registration

    v = views.vec64(spark, sf)
    return registration.correspond(v.where("pid % 2 = 0"), v.where("pid % 2 = 1"), "mutual").select("s", "t", F.round("dist", 6).alias("dist"))


@query("union_nn_join", f"with {_NN}, m as (select * from st union all select * from ts) select s, t, round(dist, 6) as dist from (select *, row_number() over (order by dist, s, t) as r, count(*) over () as n from m) where r <= floor(n * 0.5)")
def union_nn_join(spark, sf):
    from pointmill.operators import registration

    v = views.vec64(spark, sf)
    return registration.correspond(v.where("pid % 2 = 0"), v.where("pid % 2 = 1"), "union").select("s", "t", F.round("dist", 6).alias("dist"))


@query("icp_nn_join", "select qid, nid, round(dist, 6) as dist from (select *, row_number() over (partition by qid order by dist, nid) as r from (select a.pid as qid, b.pid as nid, sqrt(power(a.x + 0.1 - b.x, 2) + power(a.y - 0.05 - b.y, 2) + power(a.z - b.z, 2)) as dist from pts3 a, pts3 b where a.pid % 2 = 0 and b.pid % 2 = 1)) where r = 1 and dist * dist <= 0.25")
def icp_nn_join(spark, sf):
    p = views.pts3(spark, sf)
    q = p.where("pid % 2 = 0").withColumn("x", F.col("x") + 0.1).withColumn("y", F.col("y") - 0.05)
    near = spatial.knn_join(q, p.where("pid % 2 = 1"), 1)
    return near.where("dist * dist <= 0.25").select("qid", "nid", F.round("dist", 6).alias("dist"))


@query("anti_index", "select pid from pts3 where pid not in (select pid from pts3 where x > 0)")
def anti_index(spark, sf):
    p = views.pts3(spark, sf)
    return p.join(p.where("x > 0").select("pid"), "pid", "left_anti").select("pid")


@query("gather_join", "select i.slot, p.pid, p.x from (select l_linenumber as slot, l_orderkey % 500 as pid from lineitem) i join pts3 p using (pid)")
def gather_join(spark, sf):
    i = views.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("slot"), (F.col("l_orderkey") % 500).alias("pid"))
    return i.join(views.pts3(spark, sf), "pid").select("slot", "pid", "x")


@query(
    "interp_3nn",
    """with n as (select *, row_number() over (partition by qid order by dist, nid) as r from (select a.pid as qid, b.pid as nid, b.x as bx, b.z as bz, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as dist from pts3 a, pts3 b where a.pid % 4 <> 0 and b.pid % 4 = 0))
    select qid, round(sum(bx / (dist * dist + 1e-8)) / sum(1 / (dist * dist + 1e-8)), 6) as x, round(sum(bz / (dist * dist + 1e-8)) / sum(1 / (dist * dist + 1e-8)), 6) as z from n where r <= 3 group by qid""",
)
def interp_3nn(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.interpolate(p.where("pid % 4 <> 0"), p.where("pid % 4 = 0"), ("x", "z")).select("qid", *R6("x", "z"))


@query(
    "ball_query",
    f"""with w as (select qid, nid, row_number() over (partition by qid order by nid) as r from ({_ALL}) where dist <= 0.7), i as (select qid, list(nid order by nid) as ids from w where r <= 6 group by qid)
    select qid, s::int as slot, coalesce(ids[s + 1], ids[1]) as nid from i, range(6) t(s)""",
)
def ball_query(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.ball_query(p, p, 0.7, 6)


@query("pairwise_sqdist", "select a.frame, a.pid as qid, b.pid as nid, round(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), 6) as sqdist from pts3 a join pts3 b on a.frame = b.frame")
def pairwise_sqdist(spark, sf):
    p = views.pts3(spark, sf)
    return spatial.pairwise(p, p).select("frame", "qid", "nid", F.round("sqdist", 6).alias("sqdist"))


# --- aggregates --------------------------------------------------------------------------


@query("agg_centroid", "select frame, round(avg(x), 6) as mx, round(avg(y), 6) as my, round(avg(z), 6) as mz from pts_big group by frame")
def agg_centroid(spark, sf):
    return linalg.stats(views.pts_big(spark, sf), ("frame",)).select("frame", *R6("mx", "my", "mz"))


@query("agg_bounds", "select frame, min(x) as minx, min(y) as miny, min(z) as minz, max(x) as maxx, max(y) as maxy, max(z) as maxz from pts_big group by frame")
def agg_bounds(spark, sf):
    return linalg.stats(views.pts_big(spark, sf), ("frame",)).select("frame", "minx", "miny", "minz", "maxx", "maxy", "maxz")


_SCATTER = "count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, covar_pop(x, x) * count(*) as cxx, covar_pop(x, y) * count(*) as cxy, covar_pop(x, z) * count(*) as cxz, covar_pop(y, y) * count(*) as cyy, covar_pop(y, z) * count(*) as cyz, covar_pop(z, z) * count(*) as czz"


@query("agg_scatter3", f"select frame, n, round(cxx, 4) as cxx, round(cxy, 4) as cxy, round(cxz, 4) as cxz, round(cyy, 4) as cyy, round(cyz, 4) as cyz, round(czz, 4) as czz from (select frame, {_SCATTER} from pts3 group by frame)")
def agg_scatter3(spark, sf):
    return linalg.stats(views.pts3(spark, sf), ("frame",)).select("frame", "n", *[F.round(c, 4).alias(c) for c in geometry.SYM])


@query("pca", f"with s as (select frame, {_SCATTER} from pts3 group by frame), {geometry.eigen_sql('s', 'frame')} select frame, round(l1, 4) as l1, round(l2, 4) as l2, round(l3, 4) as l3, round(nx, 5) as nx, round(ny, 5) as ny, round(nz, 5) as nz from e")
def pca(spark, sf):
    p = linalg.pca(views.pts3(spark, sf), ("frame",))
    return p.select("frame", *[F.round(c, 4).alias(c) for c in ("l1", "l2", "l3")], *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")])


@query("plane_fit", f"with s as (select frame, {_SCATTER} from pts3 group by frame), {geometry.eigen_sql('s', 'frame, n, mx, my, mz')} select frame, n, round(nx, 5) as nx, round(ny, 5) as ny, round(nz, 5) as nz, round(-(nx * mx + ny * my + nz * mz), 5) as d from e")
def plane_fit(spark, sf):
    return linalg.plane_fit(views.pts3(spark, sf), ("frame",)).select("frame", "n", *[F.round(c, 5).alias(c) for c in ("nx", "ny", "nz", "d")])


_NBR = f"k_ as (select qid, nid from (select *, row_number() over (partition by qid order by dist, nid) as r from ({_ALL})) where r <= 8), s as (select qid, {_SCATTER} from k_ join pts3 on nid = pid group by qid)"


@query("normals_knn", f"with {_NBR}, {geometry.eigen_sql('s', 'qid, n')} select qid as pid, n as n_neigh, round(l1, 4) as l1, round(l3, 4) as l3, round(abs(nx), 4) as ax, round(abs(ny), 4) as ay, round(abs(nz), 4) as az from e where (l2 - l3) > 1e-6 * l1")
def normals_knn(spark, sf):
    n = linalg.normals(views.pts3(spark, sf), 8)
    return n.where("(l2 - l3) > 1e-6 * l1").select("pid", "n_neigh", F.round("l1", 4).alias("l1"), F.round("l3", 4).alias("l3"), *[F.round(F.abs(f"n{c}"), 4).alias(f"a{c}") for c in "xyz"])


@query("normals_hybrid", f"with h as (select qid, nid from (select *, row_number() over (partition by qid order by dist, nid) as r from ({_ALL}) where dist <= 1.0) where r <= 10), s as (select qid, {_SCATTER} from h join pts3 on nid = pid group by qid) select qid as pid, n as n_neigh from s")
def normals_hybrid(spark, sf):
    return linalg.normals(views.pts3(spark, sf), 10, r=1.0).select("pid", "n_neigh")


@query(
    "agg_weighted_cov",
    f"""with p_ as (select qid, nid from ({_ALL}) where dist <= 0.9), m as (select qid as nid, count(*) as m from p_ group by qid)
    select qid, count(*) as n, round(sum((b.x - a.x) * (b.x - a.x) / m) / sum(1.0 / m), 5) as cxx, round(sum((b.x - a.x) * (b.y - a.y) / m) / sum(1.0 / m), 5) as cxy, round(sum((b.z - a.z) * (b.z - a.z) / m) / sum(1.0 / m), 5) as czz
    from p_ join m using (nid) join pts3 a on a.pid = qid join pts3 b on b.pid = nid group by qid""",
)
def agg_weighted_cov(spark, sf):
    p = views.pts3(spark, sf)
    return linalg.weighted_cov(spatial.radius_join(p, p, 0.9), p).select("qid", "n", *[F.round(c, 5).alias(c) for c in ("cxx", "cxy", "czz")])


_VOX = "b as (select min(x) as a, min(y) as b, min(z) as c from pts_big), h as (select p.*, floor((x - b.a) / 5)::bigint as hx, floor((y - b.b) / 5)::bigint as hy, floor((z - b.c) / 5)::bigint as hz from pts_big p, b)"


@query("voxel_centroid", f"with {_VOX} select hx, hy, hz, count(*) as n, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z from h group by hx, hy, hz")
def voxel_centroid(spark, sf):
    return filters.voxel(views.pts_big(spark, sf), 5.0).select("hx", "hy", "hz", "n", *R6("x", "y", "z"))


@query("voxel_random", "with b as (select min(x) as a, min(y) as b, min(z) as c from pts3), h as (select p.*, floor((x - b.a) / 2)::bigint as hx, floor((y - b.b) / 2)::bigint as hy, floor((z - b.c) / 2)::bigint as hz from pts3 p, b), r as (select *, row_number() over (partition by hx, hy, hz order by (pid * 7919) % 1000003, pid) as r from h) select hx, hy, hz, pid, x, y, z from r where r = 1")
def voxel_random(spark, sf):
    return filters.voxel(views.pts3(spark, sf), 2.0, mode="random")


@query("voxel_normals", "with h as (select *, floor(x / 1.75)::bigint as hx, floor(y / 1.75)::bigint as hy, floor(z / 1.75)::bigint as hz from (select *, sin(pid) as nx from pts3)) select hx, hy, hz, count(*) as n, round(avg(x), 6) as x, round(avg(nx), 6) as nx from h group by hx, hy, hz")
def voxel_normals(spark, sf):
    return filters.voxel(views.pts3(spark, sf).withColumn("nx", F.sin("pid")), 1.75, origin="zero", values=("nx",)).select("hx", "hy", "hz", "n", *R6("x", "nx"))


@query(
    "knn_outlier",
    f"""with k_ as (select qid, avg(dist) as d from (select *, row_number() over (partition by qid order by dist, nid) as r from ({_ALL})) where r <= 20 group by qid), s as (select avg(d) + 1.5 * stddev_samp(d) as lim from k_)
    select pid, frame from pts3 join k_ on qid = pid, s where d <= lim""",
)
def knn_outlier(spark, sf):
    return filters.statistical_outlier(views.pts3(spark, sf), 20, 1.5).select("pid", "frame")


@query("median_kth", "select frame, quantile_disc(x, 0.5) as lower, -quantile_disc(-x, 0.5) as upper from pts3 group by frame")
def median_kth(spark, sf):
    p = views.pts3(spark, sf)
    return linalg.median(p, "x", ("frame",)).withColumnRenamed("median", "lower").join(linalg.median(p, "x", ("frame",), "upper").withColumnRenamed("median", "upper"), "frame")


# --- order, sets ---------------------------------------------------------------------------


@query("rank_topk", _knn_sql(3))
def rank_topk(spark, sf):
    p = views.pts3(spark, sf)
    return _told(spatial.nearest(spatial.knn_brute(p, p, 6).drop("rank"), 3))


@query("sort_keys_by_values", "select pid, row_number() over (order by x)::bigint as pos from pts3")
def sort_keys_by_values(spark, sf):
    return spatial.ranked(views.pts3(spark, sf).select("pid", "x"), ["x", "pid"]).select("pid", "pos")


@query("topk_partition", "select frame, pid, z from (select *, row_number() over (partition by frame order by z, pid) as r from pts3) where r <= 10")
def topk_partition(spark, sf):
    from pyspark.sql import Window

    return views.pts3(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("frame").orderBy("z", "pid"))).where("r <= 10").select("frame", "pid", "z")


@query("top_fraction", "select pid, round(x, 6) as x from (select *, row_number() over (order by x, pid) as r, count(*) over () as n from pts3) where r <= floor(n * 0.3)")
def top_fraction(spark, sf):
    from pointmill.operators import registration

    return registration.top_fraction(views.pts3(spark, sf), 0.3, ("pid",), "x").select("pid", *R6("x"))


@query("sample_limit", "select k4, count(*) as n from pts_big where k4 % 8 = 0 group by k4 having count(*) > 50")
def sample_limit(spark, sf):
    return views.pts_big(spark, sf).where("k4 % 8 = 0").groupBy("k4").agg(F.count("*").alias("n")).where("n > 50")


@query("bst_traversals", "select key, pid, row_number() over (order by key)::bigint as pos from (select floor(x * 20)::bigint as key, min(pid) as pid from pts3 group by 1)")
def bst_traversals(spark, sf):
    return spatial.ordered_unique(views.pts3(spark, sf).withColumn("key", F.floor(F.col("x") * 20)).select("pid", "key"), "key").select("key", "pid", "pos")


@query("union", "select pid, 0 as part from pts3 where x > 0.5 union all select pid, 1 from pts3 where y > 0.5")
def union(spark, sf):
    p = views.pts3(spark, sf)
    return p.where("x > 0.5").select("pid", F.lit(0).alias("part")).unionByName(p.where("y > 0.5").select("pid", F.lit(1).alias("part")))


@query("intersect", "select pid from pts3 where x > 0 intersect select pid from pts3 where y > 0")
def intersect(spark, sf):
    p = views.pts3(spark, sf)
    return p.where("x > 0").select("pid").intersect(p.where("y > 0").select("pid"))


@query("except", "select pid from pts3 where x > 0 except select pid from pts3 where y > 0")
def except_(spark, sf):
    p = views.pts3(spark, sf)
    return p.where("x > 0").select("pid").exceptAll(p.where("y > 0").select("pid"))


# --- ground ------------------------------------------------------------------------------------

_SEG = "seg_ as (select *, case when x > -150 and x < -20 then 0 when x > -20 and x < 20 then 1 else 2 end as seg from scan where (x > -150 and x < -20) or (x > -20 and x < 20) or (x > 20 and x < 150))"


def _segmented(spark, sf):
    return filters.segment(views.scan(spark, sf), [(-150, -20), (-20, 20), (20, 150)])


_SEEDS = f"{_SEG}, low_ as (select *, row_number() over (partition by frame, seg order by z, pid) as r from seg_ where z < -1.23::double), lpr_ as (select frame, seg, avg(z) as lpr from low_ where r <= 50 group by frame, seg), g0 as (select l.frame, l.seg, l.pid, l.x, l.y, l.z from low_ l join lpr_ using (frame, seg) where z < lpr + 0.18::double)"


@query("lpr_seed", f"with {_SEEDS} select frame, seg, pid from g0")
def lpr_seed(spark, sf):
    return ground.seeds(_segmented(spark, sf), lpr=50).select("frame", "seg", "pid")


def _ground_sql(rounds: int) -> str:
    parts = [f"with {_SEEDS}"]
    for i in range(1, rounds + 1):
        parts.append(f"s{i} as (select frame, seg, {_SCATTER} from g{i - 1} group by frame, seg), {geometry.eigen_sql(f's{i}', 'frame, seg, mx, my, mz', f'e{i}_')}")
        parts.append(f"g{i} as (select p.frame, p.seg, p.pid, p.x, p.y, p.z from seg_ p join e{i}_ e using (frame, seg) where abs(e.nx * p.x + e.ny * p.y + e.nz * p.z - (e.nx * e.mx + e.ny * e.my + e.nz * e.mz)) < 0.18::double)")
    parts.append(f"a_ as (select p.frame, p.seg, p.pid from seg_ p join (select distinct frame, seg from g0) using (frame, seg))")
    return ", ".join(parts) + f" select a_.frame, a_.seg, a_.pid, g.pid is not null as is_ground from a_ left join g{rounds} g on a_.pid = g.pid"


@query("ground_svd", _ground_sql(6))
def ground_svd(spark, sf):
    return ground.svd(_segmented(spark, sf), lpr=50).select("frame", "seg", "pid", "is_ground")


@query(
    "ground_ransac",
    f"""with {_SEEDS.replace('r <= 50', 'r <= 400').replace('0.18::double', '1.0::double')}, rk as (select *, row_number() over (partition by frame, seg order by pid) - 1 as i from g0), n_ as (select frame, seg, count(*) as n from g0 group by frame, seg having count(*) >= 3),
    d_ as (select frame, seg, it::int as iter, (it * 7919 + 17) % n as r0, (it * 104729 + 29) % n as r1, (it * 1299709 + 41) % n as r2 from n_, range(40) t(it)),
    u_ as (select d_.frame, d_.seg, d_.iter, a.x as ax, a.y as ay, a.z as az, b.x - a.x as ux, b.y - a.y as uy, b.z - a.z as uz, c.x - a.x as vx, c.y - a.y as vy, c.z - a.z as vz from d_ join rk a on a.frame = d_.frame and a.seg = d_.seg and a.i = r0 join rk b on b.frame = d_.frame and b.seg = d_.seg and b.i = r1 join rk c on c.frame = d_.frame and c.seg = d_.seg and c.i = r2),
    c_ as (select *, uy * vz - uz * vy as nx, uz * vx - ux * vz as ny, ux * vy - uy * vx as nz from u_), p_ as (select frame, seg, iter, nx / s as nx, ny / s as ny, nz / s as nz, -(nx / s * ax + ny / s * ay + nz / s * az) as d from (select *, sqrt(nx * nx + ny * ny + nz * nz) as s from c_) where s > 0),
    sc as (select p_.frame, p_.seg, p_.iter, p_.nx, p_.ny, p_.nz, p_.d, count(*) filter (where abs(p_.nx * x + p_.ny * y + p_.nz * z + p_.d) < 0.15::double) as score from g0 join p_ using (frame, seg) group by all),
    best as (select *, row_number() over (partition by frame, seg order by score desc, iter) as r from sc)
    select q.frame, q.seg, q.pid, b.iter, b.score, abs(b.nx * x + b.ny * y + b.nz * z + b.d) < 0.15::double as is_ground from seg_ q join best b using (frame, seg) where b.r = 1""",
)
def ground_ransac(spark, sf):
    return ground.ransac(_segmented(spark, sf), lpr=400).select("frame", "seg", "pid", "iter", "score", "is_ground")
