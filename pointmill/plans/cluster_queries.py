"""Queries that iterate: trees, clusters, keypoints, registration, augmentation, layers, files, streams."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from pointmill.functions import geometry
from pointmill.functions.tables import shared_dir
from pointmill.operators import augment, centres, cluster, features, filters, layers, linalg, registration, spatial
from pointmill.plans import views
from pointmill.plans.point_queries import _ALL, ROT, SHIFT, _segmented
from pointmill.plans.registry import query
from pointmill.sources import formats
from pointmill.streaming import frames

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]

_RADIAL = "rad as (select *, x / s as nx, y / s as ny, z / s as nz from (select *, sqrt(x * x + y * y + z * z) as s from pts3))"

def _fps_sql(steps: int, key: str) -> str:
    """Farthest points by recursion: every round keeps each row's distance to what was chosen."""
    part = f"partition by {key} " if key else ""
    cols = f"{key}, " if key else ""
    w = f"({part}order by far desc, pid)"
    return f"""with recursive r as (select {cols}pid, x, y, z, 0 as step, 1e10::double as far from pts3
      union all
      select {cols}pid, x, y, z, step + 1, least(far, power(x - cx, 2) + power(y - cy, 2) + power(z - cz, 2)) from (select *, first_value(x) over w as cx, first_value(y) over w as cy, first_value(z) over w as cz from r window w as {w}) where step < {steps - 1}),
    picked as (select * from (select *, row_number() over (partition by {cols}step order by far desc, pid) as q from r) where q = 1)"""


_WCOV = ", ".join(f"sum((b.{p} - a.{p}) * (b.{q} - a.{q}) / m) / sum(1.0::double / m) as c{p}{q}" for p, q in ("xx", "xy", "xz", "yy", "yz", "zz"))

_ISS = f"""with p_ as (select qid, nid from ({_ALL}) where dist <= 1.0), m_ as (select qid as nid, count(*) as m from p_ group by qid),
    s as (select qid, count(*) as n, {_WCOV} from p_ join m_ using (nid) join pts3 a on a.pid = qid join pts3 b on b.pid = nid group by qid having count(*) >= 3), {geometry.eigen_sql('s', 'qid')},
    sal as (select e.qid, e.l3, p.x, p.y, p.z from e join pts3 p on p.pid = e.qid where l3 > 0 and l2 / l1 < 0.9::double and l3 / l2 < 0.9::double)
    select a.qid as pid, round(a.l3, 6) as l3, count(*) as n from sal a join sal b on sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) <= 0.8::double group by a.qid, a.l3 having count(*) >= 3 and max(b.l3) <= a.l3"""

_FPFH = f"""with {_RADIAL}, p_ as (select qid, nid, dist from ({_ALL}) where dist <= 0.9 and qid <> nid),
    d as (select qid, nid, s.nx as ux, s.ny as uy, s.nz as uz, t.nx as tx, t.ny as ty, t.nz as tz, (t.x - s.x) / dist as dx, (t.y - s.y) / dist as dy, (t.z - s.z) / dist as dz from p_ join rad s on s.pid = qid join rad t on t.pid = nid),
    v as (select *, dy * uz - dz * uy as v0, dz * ux - dx * uz as v1, dx * uy - dy * ux as v2 from d), m as (select *, v0 / s as vx, v1 / s as vy, v2 / s as vz from (select *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) as s from v) where s > 0),
    a as (select qid, vx * tx + vy * ty + vz * tz as alpha, ux * dx + uy * dy + uz * dz as phi, atan2((uy * vz - uz * vy) * tx + (uz * vx - ux * vz) * ty + (ux * vy - uy * vx) * tz, ux * tx + uy * ty + uz * tz) as theta from m),
    b as (select qid, unnest([greatest(0, least(10, floor((alpha + 1) / 2 * 11))), 11 + greatest(0, least(10, floor((phi + 1) / 2 * 11))), 22 + greatest(0, least(10, floor((theta + pi()) / (2 * pi()) * 11)))])::int as bin from a),
    o as (select qid, bin, count(*)::double / any_value(t) as share from b join (select qid, count(*) as t from a group by qid) using (qid) group by qid, bin),
    n as (select p_.qid, o.bin, sum(o.share / greatest(dist, 1e-12) / k) as share from p_ join o on o.qid = p_.nid join (select qid, count(*) as k from p_ group by qid) c on c.qid = p_.qid group by p_.qid, o.bin)
    select qid, bin, round(sum(share), 5) as value from (select * from o union all select * from n) group by qid, bin"""


def _octree_sql(leaf: int, min_extent: float) -> str:
    n = ", ".join(f"least((1 << d) - 1, greatest(0, ceil(({c} - (c{c} - half)) / (2 * half) * (1 << d))::bigint - 1)) as n{c}" for c in "xyz")
    code = " + ".join(f"list_sum(list_transform(range(20), lambda b: ((n{c} >> b::int) & 1) << (3 * b::int + {i})))" for i, c in enumerate("xyz"))
    return f"""with e as (select (min(x) + max(x)) / 2 as cx, (min(y) + max(y)) / 2 as cy, (min(z) + max(z)) / 2 as cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 2 as half from pts3),
    b as (select *, greatest(0, ceil(log2(half / {min_extent}::double)))::int as d from e),
    c as (select pid, d, ({code})::bigint as code from (select pid, d, {n} from pts3, b)), l as (select pid, d, v::int as level, code >> (3 * (d - v::int)) as morton from c, range(21) r(v) where v <= d),
    k as (select *, count(*) over (partition by level, morton) as n from l) select pid, min(level) as level, arg_min(morton, level) as morton from k where n <= {leaf} or level = d group by pid"""


_RANGE_CC = """with recursive px0 as (select pid, frame, sqrt(x * x + y * y + z * z) as d, 20 - (floor(atan2(z, sqrt(x * x + y * y)) / (3.0::double * 3.141592653589793 / 180)) + 11) as pr, 120 - (floor(atan2(y, x) / (3.0::double * 3.141592653589793 / 180)) + 61) as pc from scan),
    px1 as (select frame, pr, pc, max(pid) as pid, arg_max(d, pid) as d from px0 group by frame, pr, pc),
    px as (select frame, pid, d, dense_rank() over (partition by frame order by pr)::int - 1 as row, dense_rank() over (partition by frame order by pc)::int - 1 as col from px1), w as (select frame, max(col) + 1 as w from px group by frame),
    pr as (select a.pid as p, b.pid as q, greatest(a.d, b.d) as hi, least(a.d, b.d) as lo from px a join px b on a.frame = b.frame and a.pid <> b.pid and abs(a.row - b.row) <= 7 join w on w.frame = a.frame where least(abs(a.col - b.col), w.w - abs(a.col - b.col)) <= 7),
    ln as (select p, q from pr where atan2(lo * sin(radians(3.0::double)), hi - lo * cos(radians(3.0::double))) > radians(30.0::double) and hi - lo < 1),
    rc as (select pid as src, pid as dst from px union select rc.src, ln.q from rc join ln on rc.dst = ln.p)
    select px.frame, px.row, px.col, px.pid, min(dst) as label from px join rc on rc.src = px.pid group by all"""


def _normal_sql(k: str, seed: int, sigma: float, clip: float) -> str:
    return f"greatest(-{clip}::double, least({clip}::double, {sigma}::double * sqrt(-2 * ln({_u(k, 2 * seed + 1, 1e-6, 1.0)})) * cos(2 * pi() * {_u(f'({k} * 31 + 17)', 2 * seed + 2)})))"


def _perturb_sql(source: str, cols: str) -> str:
    x, y, z = cols.split()
    a = [_normal_sql("frame", 1 + i, 0.06, 0.18) for i in range(3)]
    return f"""q1 as (select pid, frame, {x}, cos(a) * {y} - sin(a) * {z} as {y}, sin(a) * {y} + cos(a) * {z} as {z} from (select *, {a[0]} as a from {source})),
    q2 as (select pid, frame, cos(a) * {x} - sin(a) * {z} as {x}, {y}, sin(a) * {x} + cos(a) * {z} as {z} from (select *, {a[1]} as a from q1)),
    q3 as (select pid, cos(a) * {x} - sin(a) * {y} as {x}, sin(a) * {x} + cos(a) * {y} as {y}, {z} from (select *, {a[2]} as a from q2)) select pid, {', '.join(f'round({c}, 6) as {c}' for c in (x, y, z))} from q3"""


_U = "(({k}::bigint * 7919 + {s} * 104729 + 12345) % 1000003) / 1000003.0::double"


def _u(k: str, s: int, low: float = 0.0, high: float = 1.0) -> str:
    return f"({low}::double + {_U.format(k=k, s=s)} * {high - low}::double)"


# --- trees as partitions ----------------------------------------------------------------


def _kd_sql(depth: int, leaf: int, value: str = "quantile_disc({}, 0.5)") -> str:
    parts = ["k0 as (select *, 1::bigint as node, 0 as level from pts3)"]
    for i in range(depth):
        c = "xyz"[i % 3]
        parts.append(f"m{i} as (select node, {value.format(c)} as m, {value.format(c)} >= max({c}) as top from k{i} group by node having count(*) > {leaf} and min({c}) < max({c}))")
        parts.append(f"k{i + 1} as (select k.pid, k.frame, k.x, k.y, k.z, case when m.m is not null then k.node * 2 + (case when m.top then k.{c} >= m.m else k.{c} > m.m end)::int else k.node end as node, k.level + (m.m is not null)::int as level from k{i} k left join m{i} m using (node))")
    return "with " + ", ".join(parts)


@query("kdtree_build", f"{_kd_sql(12, 32)} select pid, node, level::int as level from k12")
def kdtree_build(spark, sf):
    return spatial.kd_partition(views.pts3(spark, sf), 32).select("pid", "node", "level")


@query("kdtree_build_mean", f"{_kd_sql(18, 32, 'avg({})')} select pid, node, level::int as level from k18")
def kdtree_build_mean(spark, sf):
    return spatial.kd_partition(views.pts3(spark, sf), 32, rule="mean").select("pid", "node", "level")


@query("tree_depth", f"{_kd_sql(12, 32)} select max(level)::int as depth, count(distinct node) as leaves from k12")
def tree_depth(spark, sf):
    return spatial.kd_partition(views.pts3(spark, sf), 32).agg(F.max("level").alias("depth"), F.count_distinct("node").alias("leaves"))


@query("octree_build", _octree_sql(16, 1e-3))
def octree_build(spark, sf):
    return spatial.octree_cells(views.pts3(spark, sf), 16, 1e-3).select("pid", "level", "morton")


@query(
    "octree_leaf_sizes",
    f"select level, morton, count(*) as m from ({_octree_sql(16, 1e-3)}) group by level, morton",
)
def octree_leaf_sizes(spark, sf):
    return spatial.octree_cells(views.pts3(spark, sf), 16, 1e-3).groupBy("level", "morton").agg(F.count("*").alias("m"))


@query("octree_predicates", "select pid, abs(x) + 0.5 < 1 and abs(y) + 0.5 < 1 and abs(z) + 0.5 < 1 as inside, power(greatest(abs(x) - 1, 0), 2) + power(greatest(abs(y) - 1, 0), 2) + power(greatest(abs(z) - 1, 0), 2) < 0.25 as overlaps, power(abs(x) + 1, 2) + power(abs(y) + 1, 2) + power(abs(z) + 1, 2) < 0.25 as contains from pts3")
def octree_predicates(spark, sf):
    zero = F.lit(0.0)
    p = spatial.ball_vs_cube([F.col(c) for c in "xyz"], F.lit(0.5), [zero, zero, zero], F.lit(1.0))
    return views.pts3(spark, sf).select("pid", *[v.alias(k) for k, v in p.items()])


# --- clustering ------------------------------------------------------------------------------


def _dbscan_sql(eps: float, least: int) -> str:
    return f"""with recursive pr as (select qid, nid from ({_ALL}) where dist <= {eps}::double), co as (select qid from pr group by qid having count(*) >= {least}), ln as (select p.qid, p.nid from pr p join co a on p.qid = a.qid join co b on p.nid = b.qid),
    rc as (select qid as src, qid as dst from co union select rc.src, ln.nid from rc join ln on rc.dst = ln.qid), cc as (select src as qid, min(dst) as cluster from rc group by src),
    bo as (select p.qid, min(c.cluster) as cluster from pr p join cc c on p.nid = c.qid where p.qid not in (select qid from co) group by p.qid)
    select pid, coalesce(cc.cluster, bo.cluster, -1) as cluster, cc.qid is not null as core from pts3 left join cc on cc.qid = pid left join bo on bo.qid = pid"""


@query("dbscan", _dbscan_sql(0.5, 5))
def dbscan(spark, sf):
    return cluster.dbscan(views.pts3(spark, sf), 0.5, 5).select("pid", "cluster", "core")


@query("cluster_sizes", _dbscan_sql(0.8, 20).replace("select pid, coalesce(cc.cluster, bo.cluster, -1) as cluster, cc.qid is not null as core from", "select coalesce(cc.cluster, bo.cluster, -1) as cluster, count(*) as n from") + " group by 1")
def cluster_sizes(spark, sf):
    return cluster.dbscan(views.pts3(spark, sf), 0.8, 20).groupBy("cluster").agg(F.count("*").alias("n"))


@query("range_image_cc", _RANGE_CC)
def range_image_cc(spark, sf):
    from pointmill.operators import ground

    px = ground.range_image(views.scan(spark, sf), 3.0)
    return cluster.range_image(px, 3.0)


@query("neighbourhood_modes", """with s as (select a::int as dr, b::int as dc from range(-2, 3) t(a), range(-2, 3) u(b) where a <> 0 or b <> 0)
    select 4 as mode, dr, dc from s where abs(dr) + abs(dc) = 1 union all select 8, dr, dc from s where greatest(abs(dr), abs(dc)) = 1
    union all select 12, dr, dc from s where abs(dr) + abs(dc) <= 2 union all select 20, dr, dc from s where not (abs(dr) = 2 and abs(dc) = 2)""")
def neighbourhood_modes(spark, sf):
    return spark.createDataFrame([(m, a, b) for m, s in cluster.STENCILS.items() for a, b in s], "mode int, dr int, dc int")


_INIT = [(0, 0.5, 0.5, 0.5), (1, -0.5, -0.5, 0.0), (2, 0.0, 1.0, -1.0)]


def _kmeans_sql(rounds: int) -> str:
    out = [f"c0 as (select k, x::double as x, y::double as y, z::double as z from (values {', '.join(map(str, _INIT))}) t(k, x, y, z))"]
    pick = "(select p.*, c.k, row_number() over (partition by p.pid order by power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2), c.k) as r from pts3 p, c{} c)"
    for i in range(rounds):
        out.append(f"c{i + 1} as materialized (select k, avg(x) as x, avg(y) as y, avg(z) as z from {pick.format(i)} where r = 1 group by k)")
    return f"with {', '.join(out)} select pid, k from {pick.format(rounds)} where r = 1"


@query("kmeans", _kmeans_sql(40))
def kmeans(spark, sf):
    start = spark.createDataFrame(_INIT, "k int, x double, y double, z double")
    return cluster.kmeans(views.pts3(spark, sf), 3, start, tol=1e-9, max_iter=40)[0]


@query("kmeans_seed", f"{_fps_sql(4, '')} select step::int as k, x, y, z from picked")
def kmeans_seed(spark, sf):
    found = cluster.seed_spread(views.pts3(spark, sf), 4)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(found)], "k int, x double, y double, z double")


def _distinct_sql(k: int, least: float) -> str:
    far = lambda i: f"power(p.x - s{i}.x, 2) + power(p.y - s{i}.y, 2) + power(p.z - s{i}.z, 2) > {least}::double"
    steps = [f"s{j} as (select p.* from pts3 p{''.join(f', s{i}' for i in range(j))} where {' and '.join(far(i) for i in range(j)) or 'true'} order by p.pid limit 1)" for j in range(k)]
    return f"with {', '.join(steps)} " + " union all ".join(f"select {j} as k, x, y, z from s{j}" for j in range(k))


@query("seed_distinct", _distinct_sql(4, 6.0))
def seed_distinct(spark, sf):
    found = cluster.seed_distinct(views.pts3(spark, sf), 4, 6.0)
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(found)], "k int, x double, y double, z double")


_MIXTURE = cluster.Mixture([0.4, 0.6], [[0.5, 0.5, 0.5], [-0.5, -0.5, 0.0]], [[[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[1.5, 0.2, 0.0], [0.2, 1.5, 0.0], [0.0, 0.0, 1.5]]])
_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _mixture_sql(rounds: int) -> str:
    """EM unrolled: a table of components for each round; full covariances, their inverses by cofactors."""
    rows = ", ".join(f"({k}, {w}, {', '.join(map(str, m))}, {c[0][0]}, {c[0][1]}, {c[0][2]}, {c[1][1]}, {c[1][2]}, {c[2][2]})" for k, (w, m, c) in enumerate(zip(_MIXTURE.weights, _MIXTURE.means, _MIXTURE.covariances, strict=True)))
    cast = ", ".join(f"{c}::double as {c}" for c in ("pi", "mx", "my", "mz", *(f"c{p}" for p in _PAIRS)))
    out = [f"g0 as (select k, {cast} from (values {rows}) t(k, pi, mx, my, mz, {', '.join(f'c{p}' for p in _PAIRS)}))"]
    for i in range(rounds):
        out.append(f"""i{i} as (select *, cyy * czz - cyz * cyz as a, cxz * cyz - cxy * czz as b, cxy * cyz - cxz * cyy as c, cxx * czz - cxz * cxz as d, cxy * cxz - cxx * cyz as e, cxx * cyy - cxy * cxy as f from g{i}),
        p{i} as (select pid, x, y, z, k, ln(pi) - 0.5 * ln(power(2 * pi(), 3) * det) - ((x - mx) * (x - mx) * a + (y - my) * (y - my) * d + (z - mz) * (z - mz) * f + 2 * ((x - mx) * (y - my) * b + (x - mx) * (z - mz) * c + (y - my) * (z - mz) * e)) / det / 2 as l
          from pts3, (select *, cxx * a + cxy * b + cxz * c as det from i{i})),
        r{i} as materialized (select *, exp(l - m) / sum(exp(l - m)) over (partition by pid) as r from (select *, max(l) over (partition by pid) as m from p{i})),
        m{i} as (select k, avg(r) as pi, sum(r) as s, sum(r * x) / sum(r) as mx, sum(r * y) / sum(r) as my, sum(r * z) / sum(r) as mz from r{i} group by k),
        g{i + 1} as materialized (select k, any_value(m.pi) as pi, any_value(mx) as mx, any_value(my) as my, any_value(mz) as mz, {', '.join(f'sum(r * ({p[0]} - m{p[0]}) * ({p[1]} - m{p[1]})) / any_value(s) as c{p}' for p in _PAIRS)} from r{i} join m{i} m using (k) group by k)""")
    return f"with {', '.join(out)}"


@query("gmm", f"{_mixture_sql(4)} select k, round(pi, 5) as pi, round(mx, 5) as x, round(my, 5) as y, round(mz, 5) as z, {', '.join(f'round(c{p}, 5) as c{p}' for p in _PAIRS)} from g4")
def gmm(spark, sf):
    m = cluster.gmm(views.pts3(spark, sf), _MIXTURE, tol=0.0, max_iter=4)[1]
    rows = [(k, *(round(float(v), 5) for v in (w, *mean, c[0][0], c[0][1], c[0][2], c[1][1], c[1][2], c[2][2]))) for k, (w, mean, c) in enumerate(zip(m.weights, m.means, m.covariances, strict=True))]
    return spark.createDataFrame(rows, "k int, pi double, x double, y double, z double, " + ", ".join(f"c{p} double" for p in _PAIRS))


@query("gmm_em", f"{_mixture_sql(6)} select pid, arg_max(k, l)::int as k from (select pid, k, ln(g.pi) - 0.5 * ln(det) - ((x - mx) * (x - mx) * a + (y - my) * (y - my) * d + (z - mz) * (z - mz) * f + 2 * ((x - mx) * (y - my) * b + (x - mx) * (z - mz) * c + (y - my) * (z - mz) * e)) / det / 2 as l from pts3, (select *, cxx * a + cxy * b + cxz * c as det from (select *, cyy * czz - cyz * cyz as a, cxz * cyz - cxy * czz as b, cxy * cyz - cxz * cyy as c, cxx * czz - cxz * cxz as d, cxy * cxz - cxx * cyz as e, cxx * cyy - cxy * cxy as f from g6)) g) group by pid")
def gmm_em(spark, sf):
    return cluster.gmm(views.pts3(spark, sf), _MIXTURE, tol=0.0, max_iter=6)[0]


_GRAPH = f"g as (select qid as src, nid as dst, 1 / greatest(dist, 1e-12) as w from (select *, row_number() over (partition by qid order by dist, nid) as r from ({_ALL})) where r <= 10 and qid <> nid), n_ as (select src, dst, w / sum(w) over (partition by src) as w from g)"


@query("knn_graph", f"with {_GRAPH} select src, dst, round(w, 6) as w from n_")
def knn_graph(spark, sf):
    return cluster.knn_graph(views.pts3(spark, sf), 10).select("src", "dst", *R6("w"))


@query("laplacian", f"with {_GRAPH} select src as i, dst as j, round(-w, 6) as value from n_ union all select distinct src, src, 1.0::double from n_")
def laplacian(spark, sf):
    return cluster.laplacian(cluster.knn_graph(views.pts3(spark, sf), 10)).select("i", "j", *R6("value"))


@query(
    "laplacian_rnn",
    f"""with e as (select qid as src, nid as dst, 1 / greatest(dist, 1e-12) as w from ({_ALL}) where dist <= 0.5 and qid <> nid), n_ as (select src, dst, w / sum(w) over (partition by src) as w from e), l as (select src as i, dst as j, -w as v from n_ union all select distinct src, src, 1.0::double from n_)
    select i, j, round(sum(v) / 2, 6) as value from (select * from l union all select j, i, v from l) group by i, j""",
)
def laplacian_rnn(spark, sf):
    return cluster.laplacian_radius(views.pts3(spark, sf), 0.5).select("i", "j", *R6("value"))


def _drawn_sql(k: int, seed: int) -> str:
    """Each draw unrolled: distances to the nearest centre so far, their mean, the least exponential key."""
    u = lambda step: f"(('0x' || substr(md5('{seed}:{step}:' || pid), 1, 13))::bigint + 1)::double / {1 << 52}"
    steps = [f"s0 as (select x, y, z from pts3 order by {u(0)}, pid limit 1)"]
    for i in range(1, k):
        d = ", ".join(f"power(p.x - s{j}.x, 2) + power(p.y - s{j}.y, 2) + power(p.z - s{j}.z, 2)" for j in range(i))
        steps.append(f"d{i} as (select p.*, sqrt(least({d})) as d from pts3 p, {', '.join(f's{j}' for j in range(i))})")
        steps.append(f"s{i} as (select x, y, z from d{i} where d >= (select avg(d) from d{i}) * (1 - 1e-12::double) order by ln(-ln({u(i)})) - d, pid limit 1)")
    return f"with {', '.join(steps)} " + " union all ".join(f"select {j} as k, x, y, z from s{j}" for j in range(k))


@query("kmeans_seed_drawn", _drawn_sql(5, 7))
def kmeans_seed_drawn(spark, sf):
    found = centres.seed_drawn(views.pts3(spark, sf), 5, 7)
    return spark.createDataFrame([(i, *p) for i, p in enumerate(found)], "k int, x double, y double, z double")


@query("minibatch_kmeans")
def minibatch_kmeans(spark, sf):
    return centres.minibatch_kmeans(views.pts3(spark, sf), [p[1:] for p in _INIT], 4, passes=3, tol=None)[0]


@query("estimate_bandwidth", f"select round(avg(dist), 6) as bandwidth from (select qid, dist, row_number() over (partition by qid order by dist, nid) as r from ({_ALL})) where r = (select greatest(1, (0.1::double * count(*))::int) from pts3)")
def estimate_bandwidth(spark, sf):
    return spark.createDataFrame([(round(centres.estimate_bandwidth(views.pts3(spark, sf), 0.1), 6),)], "bandwidth double")


@query("mean_shift_binned")
def mean_shift_binned(spark, sf):
    return centres.mean_shift_seeded(views.pts3(spark, sf), 1.0)[0]


@query("spectral")
def spectral(spark, sf):
    return cluster.spectral(views.pts3(spark, sf), ("frame",))


@query("cluster_rules", "select frame, seg, min(z) as zmin, max(z) as zmax, count(*) as n, case when min(z) + 1.73::double > 0.5 or max(z) - min(z) < 1 or max(z) - min(z) > 2.3::double then 3 else 0 end as verdict from (select *, case when x > -150 and x < -20 then 0 when x > -20 and x < 20 then 1 else 2 end as seg from scan where (x > -150 and x < -20) or (x > -20 and x < 20) or (x > 20 and x < 150)) group by frame, seg")
def cluster_rules(spark, sf):
    return cluster.rules(_segmented(spark, sf), -1.73, key=("frame", "seg"))


# --- keypoints and descriptors -----------------------------------------------------------------


def _with_normals(spark, sf):
    p = views.pts3(spark, sf)
    return p.join(linalg.normals(p, 10).select("pid", "nx", "ny", "nz"), "pid")


def _radial(spark, sf):
    """Points with an exact stand-in for normals: the direction from the origin."""
    p = views.pts3(spark, sf)
    size = F.sqrt(sum((F.col(c) * F.col(c) for c in "xyz"), F.lit(0.0)))
    return p.select("*", *[(F.col(c) / size).alias(f"n{c}") for c in "xyz"])


@query("iss_keypoints", _ISS)
def iss_keypoints(spark, sf):
    return features.iss(views.pts3(spark, sf), 1.0, 0.8, min_n=3).select("pid", F.round("l3", 6).alias("l3"), "n")




@query(
    "harris3d",
    f"""with {_RADIAL}, p_ as (select qid, nid from ({_ALL}) where dist <= 0.9), c as (select qid, avg(nx * nx) as a, avg(nx * ny) as b, avg(nx * nz) as c, avg(ny * ny) as d, avg(ny * nz) as e, avg(nz * nz) as f from p_ join rad on nid = pid group by qid),
    h as (select qid, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) - 0.04::double * power(a + d + f, 2) as v from c), t as (select p_.qid, max(v) as top from p_ join h on h.qid = p_.nid group by p_.qid)
    select h.qid as pid, round(v, 6) as response from h join t using (qid) where v >= top and v > -1""",
)
def harris3d(spark, sf):
    return features.harris3d(_radial(spark, sf), 0.9, threshold=-1.0).select("pid", F.round("response", 6).alias("response"))


@query("fpfh33", _FPFH)
def fpfh33(spark, sf):
    return features.fpfh_bins(_radial(spark, sf), 0.9).select("qid", "bin", F.round("value", 5).alias("value"))


@query(
    "spfh",
    f"""with {_RADIAL}, p_ as (select qid, nid, dist from ({_ALL}) where dist <= 0.9 and qid <> nid),
    d as (select qid, nid, s.nx as ux, s.ny as uy, s.nz as uz, t.nx as tx, t.ny as ty, t.nz as tz, (t.x - s.x) / dist as dx, (t.y - s.y) / dist as dy, (t.z - s.z) / dist as dz from p_ join rad s on s.pid = qid join rad t on t.pid = nid),
    v as (select *, dy * uz - dz * uy as vx, dz * ux - dx * uz as vy, dx * uy - dy * ux as vz from d), m as (select *, sqrt(vx * vx + vy * vy + vz * vz) as s from v where sqrt(vx * vx + vy * vy + vz * vz) > 0)
    select qid, count(*) as n, round(avg(abs((vx * tx + vy * ty + vz * tz) / s)), 5) as alpha, round(avg(ux * dx + uy * dy + uz * dz), 5) as phi from m group by qid""",
)
def spfh(spark, sf):
    a = features.mean_angles(_radial(spark, sf), 0.9)
    return a.select("qid", "n", *[F.round(c, 5).alias(c) for c in ("alpha", "phi")])


def _shot_sql(r: float) -> str:
    """Frames by the closed form of eigenvectors, then each neighbour's shares of the sixteen bins around it."""
    dot = lambda a, b: f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"
    off = lambda v: f"case when abs{dot('d', v)} > 1e-6 * dist then {dot('d', v)} else 0 end"
    r_ = f"{r}::double"
    low = lambda c, n: f"greatest(0, least({n - 1}, floor({c}) + i_{c}))"
    return f"""with {_RADIAL}, o as (select qid, nid, dist, t.x - s.x as dx, t.y - s.y as dy, t.z - s.z as dz, t.nx as mx, t.ny as my, t.nz as mz from ({_ALL}) p join rad s on s.pid = qid join rad t on t.pid = nid where dist <= {r_} and qid <> nid),
    c as (select qid, {", ".join(f"sum(({r_} - dist) * d{s[1]} * d{s[2]}) / nullif(sum({r_} - dist), 0) as {s}" for s in geometry.SYM)} from o group by qid), m as (select qid, {", ".join(f"-{s} as {s}" for s in geometry.SYM)} from c),
    {geometry.eigen_sql("c", "qid", "e")}, {geometry.eigen_sql("m", "qid", "f")},
    a as (select e.qid, {", ".join(f"case when e.l2 - e.l3 > 1e-6 * e.l1 and e.l1 - e.l2 > 1e-6 * e.l1 then e.n{c} end as z{c}" for c in "xyz")}, f.nx as xx, f.ny as xy, f.nz as xz from e join f using (qid)),
    g as (select o.qid, {", ".join(f"any_value({t}{c}) as {t}{c}" for t in "zx" for c in "xyz")}, coalesce(nullif(sum(sign({off("z")})), 0), sum({off("z")})) as sz, coalesce(nullif(sum(sign({off("x")})), 0), sum({off("x")})) as sx from o join a using (qid) group by o.qid),
    h as (select qid, {", ".join(f"case when s{t} < 0 then -{t}{c} else {t}{c} end as {t}{c}" for t in "zx" for c in "xyz")} from g where zx is not null and xx is not null),
    y as (select *, zy * xz - zz * xy as yx, zz * xx - zx * xz as yy, zx * xy - zy * xx as yz from h),
    l as (select o.qid, (atan2({dot("d", "y")}, {dot("d", "x")}) + pi()) / (2 * pi()) * 8 - 0.5 as sector, asin(greatest(-1, least(1, {dot("d", "z")} / dist))) / pi() * 2 + 0.5 as elevation, dist / {r_} * 2 - 0.5 as shell, (greatest(-1, least(1, {dot("m", "z")})) + 1) / 2 * 11 - 0.5 as slot from o join y using (qid)),
    w as (select qid, ((((floor(sector)::int + i_sector + 8) % 8) * 2 + {low("elevation", 2)}) * 2 + {low("shell", 2)}) * 11 + {low("slot", 11)} as bin, {" * ".join(f"case when i_{k} = 0 then 1 - {k} + floor({k}) else {k} - floor({k}) end" for k in ("sector", "elevation", "shell", "slot"))} as v
      from l, (values (0), (1)) s1(i_sector), (values (0), (1)) s2(i_elevation), (values (0), (1)) s3(i_shell), (values (0), (1)) s4(i_slot)),
    b as (select qid, bin, sum(v) as v from w group by qid, bin having sum(v) > 0)
    select qid as pid, bin::int as bin, round(v / sqrt(sum(v * v) over (partition by qid)), 4) as value from b"""


@query("shot352", _shot_sql(0.9))
def shot352(spark, sf):
    return features.shot_bins(_radial(spark, sf), 0.9).where("bin is not null").select("pid", "bin", F.round("value", 4).alias("value"))


@query(
    "normal_space_sampling",
    f"""with {_RADIAL}, b as (select *, least(3, floor((nx + 1) / 2 * 4)) as bx, least(3, floor((ny + 1) / 2 * 4)) as by_, least(3, floor((nz + 1) / 2 * 4)) as bz from rad), r as (select *, row_number() over (partition by bx, by_, bz order by (pid * 7919) % 1000003, pid) as r from b)
    select pid from (select pid, row_number() over (order by r, bx, by_, bz) as q from r) where q <= 100""",
)
def normal_space_sampling(spark, sf):
    return filters.normal_space(_radial(spark, sf), 4, 100).select("pid")


@query("fps", f"{_fps_sql(12, 'frame')} select frame, step::int as step, pid from picked")
def fps(spark, sf):
    return filters.fps(views.pts3(spark, sf), 12, ("frame",)).select("frame", "step", "pid")


@query("resample_fixed_n", f"{_fps_sql(48, 'frame')}, n_ as (select frame, count(*) as n from pts3 group by frame), i_ as (select frame, pid, row_number() over (partition by frame order by pid) - 1 as i from pts3) select frame, step::int as slot, pid from picked join n_ using (frame) where n > 48 union all select frame, s::int, pid from i_ join n_ using (frame), range(48) t(s) where n <= 48 and s % n = i")
def resample_fixed_n(spark, sf):
    return filters.resample(views.pts3(spark, sf), 48, ("frame",)).select("frame", "slot", "pid")


# --- registration --------------------------------------------------------------------------------


def _moved(df):
    return registration.moved(df, np.array(ROT), np.array(SHIFT))


def _pose(spark, r, t, **more):
    names = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]
    values = [round(float(v), 4) + 0.0 for v in [*r.ravel(), *t]]
    return spark.createDataFrame([(*values, *more.values())], ", ".join(f"{n} double" for n in names) + "".join(f", {k} {'long' if isinstance(v, int) else 'double'}" for k, v in more.items()))


_POSE = "select " + ", ".join(f"{round(v, 4)}::double as {n}" for n, v in zip([f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"], [x for r in ROT for x in r] + SHIFT, strict=True))


@query("icp_point2point", _POSE)
def icp_point2point(spark, sf):
    p = views.pts3(spark, sf)
    r, t, _ = registration.icp(p, _moved(p), max_iter=25)
    return _pose(spark, r, t)


@query("icp_point2plane", _POSE)
def icp_point2plane(spark, sf):
    p = views.pts3(spark, sf)
    q = _moved(p)
    q = q.join(linalg.normals(q, 10).select("pid", "nx", "ny", "nz"), "pid")
    start, _, _ = registration.icp(p, q, max_iter=3)
    r, t, _ = registration.icp(p, q, "plane", max_iter=25, init=(start, np.zeros(3)))
    return _pose(spark, r, t)


@query("ransac_rigid", _POSE)
def ransac_rigid(spark, sf):
    p = views.pts3(spark, sf)
    corr = p.select(F.col("pid").alias("s"), F.when(F.col("pid") % 3 == 0, (F.col("pid") * 7) % 500).otherwise(F.col("pid")).alias("t"), F.lit(0.0).alias("dist"))
    r, t, _ = registration.ransac(corr, p, _moved(p), thr=0.05)
    return _pose(spark, r, t)


@query("registration_pipeline", _POSE)
def registration_pipeline(spark, sf):
    p = _with_normals(spark, sf)
    q = _moved(p)
    n = [F.col(f"n{c}") for c in "xyz"]
    turned = [sum((n[j] * ROT[i][j] for j in range(3)), F.lit(0.0)).alias(f"n{c}") for i, c in enumerate("xyz")]
    r, t = registration.register(p, q.select("pid", "frame", "x", "y", "z", *turned), mode="mutual", thr=0.1)
    return _pose(spark, r, t)


# --- augmentation ------------------------------------------------------------------------------------

_XYZ6 = "round(x, 6) as x, round(y, 6) as y, round(z, 6) as z"


@query("aug_rotate_z", f"with a as (select *, {_u('frame', 1, 0, 2 * math.pi)} as a from pts3) select pid, round(cos(a) * x - sin(a) * y, 6) as x, round(sin(a) * x + cos(a) * y, 6) as y, round(z, 6) as z from a")
def aug_rotate_z(spark, sf):
    return augment.rotate(views.pts3(spark, sf), "frame", axis="z").select("pid", *R6("x", "y", "z"))


@query("aug_rotate_y", f"with a as (select *, {_u('frame', 1, 0, 2 * math.pi)} as a from pts3) select pid, round(cos(a) * x - sin(a) * z, 6) as x, round(y, 6) as y, round(sin(a) * x + cos(a) * z, 6) as z from a")
def aug_rotate_y(spark, sf):
    return augment.rotate(views.pts3(spark, sf), "frame", axis="y").select("pid", *R6("x", "y", "z"))


@query("aug_rotate_normals", f"with {_RADIAL}, a as (select *, {_u('frame', 1, 0, 2 * math.pi)} as a from rad) select pid, round(cos(a) * nx - sin(a) * nz, 6) as nx, round(ny, 6) as ny, round(sin(a) * nx + cos(a) * nz, 6) as nz from a")
def aug_rotate_normals(spark, sf):
    return augment.rotate(_radial(spark, sf), "frame", axis="y", normals=True).select("pid", *R6("nx", "ny", "nz"))


@query("aug_rotate_angle", "select pid, round(cos(0.7::double) * x - sin(0.7::double) * z, 6) as x, round(y, 6) as y, round(sin(0.7::double) * x + cos(0.7::double) * z, 6) as z from pts3")
def aug_rotate_angle(spark, sf):
    return augment.rotate_by(views.pts3(spark, sf), 0.7).select("pid", *R6("x", "y", "z"))


@query("aug_rotate_angle_normals", f"with {_RADIAL} select pid, round(cos(0.7::double) * nx - sin(0.7::double) * nz, 6) as nx, round(sin(0.7::double) * nx + cos(0.7::double) * nz, 6) as nz from rad")
def aug_rotate_angle_normals(spark, sf):
    return augment.rotate_by(_radial(spark, sf), 0.7, normals=True).select("pid", *R6("nx", "nz"))


@query("aug_perturb", "with " + _perturb_sql("pts3", "x y z"))
def aug_perturb(spark, sf):
    return augment.perturb(views.pts3(spark, sf), "frame").select("pid", *R6("x", "y", "z"))


@query("aug_perturb_normals", f"with {_RADIAL}, " + _perturb_sql("rad", "nx ny nz"))
def aug_perturb_normals(spark, sf):
    return augment.perturb(_radial(spark, sf), "frame", normals=True).select("pid", *R6("nx", "ny", "nz"))


@query("aug_jitter", "select pid, " + ", ".join(f"round({c} + {_normal_sql('pid', 1 + 10 * i, 0.01, 0.05)}, 6) as {c}" for i, c in enumerate("xyz")) + " from pts3")
def aug_jitter(spark, sf):
    return augment.jitter(views.pts3(spark, sf)).select("pid", *R6("x", "y", "z"))


@query("aug_shift", f"select pid, round(x + {_u('frame', 1, -0.1, 0.1)}, 6) as x, round(y + {_u('frame', 2, -0.1, 0.1)}, 6) as y, round(z + {_u('frame', 3, -0.1, 0.1)}, 6) as z from pts3")
def aug_shift(spark, sf):
    return augment.shift(views.pts3(spark, sf), "frame").select("pid", *R6("x", "y", "z"))


@query("aug_scale", f"with s as (select pid, x * {_u('frame', 1, 0.8, 1.25)} as x, y * {_u('frame', 1, 0.8, 1.25)} as y, z * {_u('frame', 1, 0.8, 1.25)} as z from pts3) select pid, {_XYZ6} from s")
def aug_scale(spark, sf):
    return augment.scale(views.pts3(spark, sf), "frame").select("pid", *R6("x", "y", "z"))


@query("aug_dropout", f"with f as (select *, first_value(x) over w as fx, first_value(y) over w as fy, first_value(z) over w as fz, {_u('pid', 101)} <= {_u('frame', 1, 0, 0.875)} as gone from pts3 window w as (partition by frame order by pid)) select pid, round(case when gone then fx else x end, 6) as x, round(case when gone then fy else y end, 6) as y, round(case when gone then fz else z end, 6) as z from f")
def aug_dropout(spark, sf):
    return augment.dropout(views.pts3(spark, sf), "frame").select("pid", *R6("x", "y", "z"))


@query("aug_local_z", f"with m as (select *, avg(x) over w as mx, avg(y) over w as my, {_u('frame', 1, 0, 2 * math.pi)} as a from pts3 window w as (partition by frame)) select pid, round(cos(a) * (x - mx) - sin(a) * (y - my) + mx, 6) as x, round(sin(a) * (x - mx) + cos(a) * (y - my) + my, 6) as y, round(z, 6) as z from m")
def aug_local_z(spark, sf):
    return augment.local_z(views.pts3(spark, sf), "frame").select("pid", *R6("x", "y", "z"))


@query("aug_shuffle_samples", "select frame, row_number() over (order by (frame * 7919 + 1) % 1000003, frame)::int as pos from (select distinct frame from pts3)")
def aug_shuffle_samples(spark, sf):
    return augment.shuffled_samples(views.pts3(spark, sf), "frame")


@query("aug_shuffle_points", "with i as (select *, row_number() over (partition by frame order by pid) - 1 as i from pts3) select frame, pid, (row_number() over (partition by frame order by (i * 7919 + 1) % 1000003, i) - 1)::int as slot from i")
def aug_shuffle_points(spark, sf):
    return augment.shuffled_points(views.pts3(spark, sf), "frame").select("frame", "pid", "slot")


_TYPE = "case when frame % 10 < 5 then 'Car' when frame % 10 < 8 then 'Pedestrian' else 'Cyclist' end"


@query("aug_offline", f"select type, case type when 'Cyclist' then 8 when 'Pedestrian' then 3 else 1 end::bigint * n as n from (select {_TYPE} as type, count(*) as n from pts3 group by 1)")
def aug_offline(spark, sf):
    kind = F.when(F.col("frame") % 10 < 5, "Car").when(F.col("frame") % 10 < 8, "Pedestrian").otherwise("Cyclist")
    return augment.offline(views.pts3(spark, sf).withColumn("type", kind), key="frame").groupBy("type").agg(F.count("*").alias("n"))


# --- layers -----------------------------------------------------------------------------------------------

_MLP = [layers.weights(3, 8, 1), layers.weights(8, 4, 2)]


def _group_sql(n: int, r: float, k: int) -> str:
    return f"""{_fps_sql(n, 'frame')}, j_ as (select c.frame, c.pid as centre, p.pid as nid, row_number() over (partition by c.pid order by p.pid) as r from picked c join pts3 p on p.frame = c.frame and power(p.x - c.x, 2) + power(p.y - c.y, 2) + power(p.z - c.z, 2) <= {r * r}::double),
    i_ as (select frame, centre, list(nid order by nid) as ids from j_ where r <= {k} group by frame, centre), e_ as (select frame, centre, s::int as slot, coalesce(ids[s + 1], ids[1]) as nid from i_, range({k}) t(s)),
    grouped as (select e_.frame, e_.centre, e_.slot, e_.nid, p.x - c.x as dx, p.y - c.y as dy, p.z - c.z as dz from e_ join picked c on c.pid = e_.centre join pts3 p on p.pid = e_.nid)"""


@query("sample_and_group", f"{_group_sql(8, 1.5, 4)} select frame, centre, slot, nid, round(dx, 6) as dx, round(dy, 6) as dy, round(dz, 6) as dz from grouped")
def sample_and_group(spark, sf):
    return layers.sample_and_group(views.pts3(spark, sf), 8, 1.5, 4, ("frame",)).select("frame", "centre", "slot", "nid", *R6("dx", "dy", "dz"))


@query("group_all", "select frame, row_number() over (partition by frame order by pid)::int - 1 as slot, pid as nid, x as dx, y as dy, z as dz from pts3")
def group_all(spark, sf):
    return layers.whole_group(views.pts3(spark, sf), ("frame",))


def _mlp_sql(layer, inputs, name):
    return ", ".join("greatest(0, " + " + ".join(f"{c} * {w}::double" for c, w in zip(inputs, row, strict=True)) + f") as {name}{i}" for i, row in enumerate(layer))


@query("shared_mlp_pool", f"with a as (select frame, {_mlp_sql(_MLP[0], 'xyz', 'a')} from pts3), b as (select frame, {_mlp_sql(_MLP[1], [f'a{i}' for i in range(8)], 'b')} from a) select frame, {', '.join(f'round(max(b{i}), 5) as f1_{i}' for i in range(4))} from b group by frame")
def shared_mlp_pool(spark, sf):
    df, names = layers.shared_mlp(views.pts3(spark, sf), "xyz", _MLP)
    return df.groupBy("frame").agg(*[F.round(F.max(c), 5).alias(c) for c in names])


@query("set_abstraction", f"{_group_sql(8, 1.5, 4)}, a as (select frame, centre, {_mlp_sql(_MLP[0], ['dx', 'dy', 'dz'], 'a')} from grouped), b as (select frame, centre, {_mlp_sql(_MLP[1], [f'a{i}' for i in range(8)], 'b')} from a) select frame, centre, {', '.join(f'round(max(b{i}), 5) as f1_{i}' for i in range(4))} from b group by frame, centre")
def set_abstraction(spark, sf):
    out = layers.set_abstraction(views.pts3(spark, sf), 8, 1.5, 4, _MLP, ("frame",))
    return out.select("frame", "centre", *[F.round(c, 5).alias(c) for c in out.columns if c.startswith("f1_")])


def _scale_sql(r: float, k: int, name: str) -> str:
    group = _group_sql(8, r, k)
    steps = f"{group}, a as (select frame, centre, {_mlp_sql(_MLP[0], ['dx', 'dy', 'dz'], 'a')} from grouped), b as (select frame, centre, {_mlp_sql(_MLP[1], [f'a{i}' for i in range(8)], 'b')} from a)"
    return f"({views.with_views(steps + ' select frame, centre, ' + ', '.join(f'round(max(b{i}), 5) as {name}_{i}' for i in range(4)) + ' from b group by frame, centre')})"


@query("set_abstraction_msg", f"select * from {_scale_sql(1.0, 4, 'f0')} join {_scale_sql(2.0, 8, 'f1')} using (frame, centre)")
def set_abstraction_msg(spark, sf):
    out = layers.set_abstraction_msg(views.pts3(spark, sf), 8, (1.0, 2.0), (4, 8), _MLP, ("frame",))
    names = [c for c in out.columns if c not in ("frame", "centre")]
    return out.select("frame", "centre", *[F.round(c, 5).alias(f"f{i // 4}_{i % 4}") for i, c in enumerate(names)])


@query(
    "feature_propagation",
    """with n as (select *, row_number() over (partition by qid order by dist, nid) as r from (select a.pid as qid, b.pid as nid, b.x as bx, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) as dist from pts3 a, pts3 b where b.pid % 4 = 0))
    select qid as pid, round(sum(bx / (dist * dist + 1e-8)) / sum(1 / (dist * dist + 1e-8)), 5) as f, any_value(p.frame) as frame from n join pts3 p on p.pid = qid where r <= 3 group by qid""",
)
def feature_propagation(spark, sf):
    p = views.pts3(spark, sf)
    return layers.feature_propagation(p, p.where("pid % 4 = 0").withColumn("f", F.col("x")), ("f",), ("frame",)).select("pid", F.round("f", 5).alias("f"), "frame")


# --- files ------------------------------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_FRAMED = "select 'Car_' || frame || '_0' as name, frame, pid, x, y, z, (row_number() over (partition by frame order by pid) - 1)::bigint as i from pts3"


def _object_files(spark, sf, cols=("x", "y", "z"), df=None):
    p = df if df is not None else views.pts3(spark, sf)
    folder = _folder(spark, "objects")
    put = formats.as_bin(p, ("frame",), cols=cols).select(F.concat(F.lit("Car_"), F.col("frame").cast("string"), F.lit("_0.bin")).alias("name"), "content")
    formats.write_files(put, folder, "name", "content").count()
    return folder


@query("scan_object_bin", f"select name as frame, i as pid, round(x::float::double, 5) as x, round(y::float::double, 5) as y, round(z::float::double, 5) as z, 'Car' as cls from ({_FRAMED})")
def scan_object_bin(spark, sf):
    return formats.read_object_bin(spark, _object_files(spark, sf)).select("frame", "pid", *[F.round(c, 5).alias(c) for c in "xyz"], "cls")


@query("scan_velodyne", f"select name as frame, i as pid, round(x::float::double, 5) as x, round(y::float::double, 5) as y, round(z::float::double, 5) as z from ({_FRAMED})")
def scan_velodyne(spark, sf):
    p = views.pts3(spark, sf).withColumn("refl", F.lit(0.5))
    return formats.read_velodyne(spark, _object_files(spark, sf, ("x", "y", "z", "refl"), p)).select("frame", "pid", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("scan_kitti_raw", f"select name as frame, i as pid, round(x::float::double, 5) as x, round(z::float::double, 5) as z, round((y / 100)::float::double, 5) as reflectance from ({_FRAMED})")
def scan_kitti_raw(spark, sf):
    p = views.pts3(spark, sf).withColumn("refl", F.col("y") / 100)
    return formats.read_velodyne(spark, _object_files(spark, sf, ("x", "y", "z", "refl"), p), reflectance=True).select("frame", "pid", *[F.round(c, 5).alias(c) for c in ("x", "z", "reflectance")])


@query("scan_bin_normals", f"with {_RADIAL} select 'Car_' || frame || '_0' as frame, (row_number() over (partition by frame order by pid) - 1)::bigint as pid, round(nx::float::double, 5) as nx, round(nz::float::double, 5) as nz from rad")
def scan_bin_normals(spark, sf):
    return formats.read_bin_normals(spark, _object_files(spark, sf, ("x", "y", "z", "nx", "ny", "nz"), _radial(spark, sf))).select("frame", "pid", F.round("nx", 5).alias("nx"), F.round("nz", 5).alias("nz"))


@query("scan_ply", f"select name as frame, i as pid, round(x::float::double, 5) as x, round(y::float::double, 5) as y, round(z::float::double, 5) as z from ({_FRAMED})")
def scan_ply(spark, sf):
    p = formats.numbered(views.pts3(spark, sf).withColumnRenamed("pid", "p"), "frame", "p")
    folder = _folder(spark, "ply")
    put = formats.ply_bytes(p).select(F.concat(F.lit("Car_"), F.col("frame").cast("string"), F.lit("_0.ply")).alias("name"), "content")
    formats.write_files(put, folder, "name", "content").count()
    return formats.read_ply(spark, folder).select("frame", "pid", *[F.round(c, 5).alias(c) for c in "xyz"])


def _text_files(spark, df, name="text"):
    folder = _folder(spark, name)
    formats.write_files(df, folder, "name", "content").count()
    return folder


def _joined_lines(spark, sf, sep, head=None):
    p = views.pts3(spark, sf)
    line = F.concat_ws(sep, *[F.format_string("%.12f", c) for c in "xyz"])
    rows = p.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("pid", line.alias("t")))).alias("r"))
    text = F.array_join(F.transform("r", lambda s: s["t"]), "\n")
    if head == "count":
        text = F.concat(F.size("r").cast("string"), F.lit("\n"), text)
    return _text_files(spark, rows.select(F.concat(F.lit("f"), F.col("frame").cast("string"), F.lit(".txt")).alias("name"), text.alias("content")))


_TXT = "select 'f' || frame as frame, (row_number() over (partition by frame order by pid) - 1)::bigint as pid, round(x, 4) as x, round(y, 4) as y, round(z, 4) as z from pts3"


@query("scan_txt_pts", _TXT)
def scan_txt_pts(spark, sf):
    return formats.read_csv(spark, _joined_lines(spark, sf, ",")).select("frame", "pid", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("scan_count_txt", _TXT)
def scan_count_txt(spark, sf):
    return formats.read_counted(spark, _joined_lines(spark, sf, " ", "count")).select("frame", "pid", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("scan_off", "select 'f' || frame as frame, count(*) as n, round(sum(x), 3) as sx, 1::bigint as faces from pts3 group by frame")
def scan_off(spark, sf):
    p = formats.numbered(views.pts3(spark, sf).withColumnRenamed("pid", "p"), "frame", "p")
    faces = p.where("pid = 0").select("frame", F.lit(0).cast("long").alias("fid"), F.array(F.lit(0), F.lit(1), F.lit(2)).alias("v"))
    put = formats.off_text(p.select("frame", "pid", *[F.col(c).cast("decimal(18,6)").cast("string").alias(c) for c in "xyz"]), faces).select(F.concat(F.lit("f"), F.col("frame").cast("string"), F.lit(".off")).alias("name"), "content")
    points, read_faces = formats.read_off(spark, _text_files(spark, put))
    return points.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("sx")).join(read_faces.groupBy("frame").agg(F.count("*").alias("faces")), "frame")


@query("scan_kitti_label", "select lpad(frame::varchar, 6, '0') as frame, count(*) as n, round(sum(x1), 2) as x1, sum(occlusion)::bigint as occlusion from gt_boxes group by frame")
def scan_kitti_label(spark, sf):
    put = formats.label_text(views.with_3d(views.gt_boxes(spark, sf))).select(F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".txt")).alias("name"), "content")
    return formats.read_labels(spark, _text_files(spark, put)).groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("x1"), 2).alias("x1"), F.sum("occlusion").alias("occlusion"))


@query("scan_kitti_det", """with f as (select bool_or(lower(type) = 'car') as has_car, bool_or(lower(type) = 'pedestrian') as has_pedestrian, bool_or(lower(type) = 'cyclist') as has_cyclist, bool_and(alpha <> -10) as aos from det_boxes)
    select lpad(frame::varchar, 6, '0') as frame, type, round(x1, 1) as x1, round(y2, 1) as y2, round(t3, 1) as t3, abs(s.score - d.score) < 0.006 as scored, f.* from det3 d, f, lateral (select round(d.score, 2) as score) s""")
def scan_kitti_det(spark, sf):
    d = views.with_3d(views.det_boxes(spark, sf), True)
    put = formats.label_text(d, detections=True).select(F.concat(F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".txt")).alias("name"), "content")
    read = formats.read_labels(spark, _text_files(spark, put), detections=True)
    rows = read.select("frame", "type", *[F.round(c, 1).alias(c) for c in ("x1", "y2", "t3")], F.col("score").between(0, 1).alias("scored"))
    return rows.join(F.broadcast(formats.detection_flags(read)), F.lit(True))  # one row


@query("scan_split_list", "select type || '_' || ord as name, type as cls from gt_boxes where ord % 10 = 3")
def scan_split_list(spark, sf):
    folder = _folder(spark, "split")
    views.gt_boxes(spark, sf).where("ord % 10 = 3").select(F.concat_ws("_", "type", "ord")).write.text(folder)
    return formats.read_split(spark, folder).select("name", "cls")


@query("sink_cluster", "select pid::varchar as value from pts3")
def sink_cluster(spark, sf):
    folder = _folder(spark, "labels")
    views.pts3(spark, sf).repartitionByRange("pid").sortWithinPartitions("pid").select(F.col("pid").cast("string")).write.text(folder)
    return spark.read.text(folder)


@query("gen_uniform", "select id as pid, ((id * 7919) % 1000) / 1000.0::double * 10 as x0, ((id * 7921 + 104729) % 1000) / 1000.0::double * 10 as x1 from range(1000) t(id)")
def gen_uniform(spark, sf):
    return formats.uniform_points(spark, 1000, 2)


def _drawn_sql(pid: str, seed: int) -> str:
    return f"(('0x' || substr(md5({pid} || ':{seed}'), 1, 13))::bigint / 4503599627370496.0::double)"


def _gauss_sql(pid: str, seed: int) -> str:
    return f"(sqrt(-2 * ln(1 - {_drawn_sql(pid, 2 * seed)})) * cos(2 * pi() * {_drawn_sql(pid, 2 * seed + 1)}))"


_BLOBS = [(0, 0, 400, 0.5, 0.5, 1.0, 3.0), (1, 400, 600, 5.5, 2.5, 2.0, 2.0), (2, 1000, 1000, 1.0, 7.0, 6.0, 2.0)]


@query("gen_gmm", " union all ".join(f"select pid, {k} as label, round({_gauss_sql('pid', 1 + 2 * k)} * {sx}::double + {mx}::double, 6) as x, round({_gauss_sql('pid', 2 + 2 * k)} * {sy}::double + {my}::double, 6) as y from range({first}, {first + n}) t(pid)" for k, first, n, mx, my, sx, sy in _BLOBS))
def gen_gmm(spark, sf):
    return formats.gaussian_blobs(spark).select("pid", "label", *R6("x", "y"))


_KINDS = ("circles", "moons", "blobs", "aniso", "varied")


def _toy_sql(kind: str) -> str:
    two = kind in ("circles", "moons")
    base = f"select pid, (pid % {2 if two else 3})::int as k, {_drawn_sql('pid', 1)} * pi() as a, {_gauss_sql('pid', 2)} as e, {_gauss_sql('pid', 3)} as f from range(1500) t(pid)"
    cx, cy, s = "case k when 0 then -6 when 1 then 0 else 6 end", "case k when 0 then 2 when 1 then -5 else 3 end", "case k when 0 then 1.0 when 1 then 2.5 else 0.5 end::double" if kind == "varied" else "1"
    x, y = {
        "circles": ("case k when 0 then 1.0 else 0.5 end::double * cos(2 * a) + 0.05::double * e", "case k when 0 then 1.0 else 0.5 end::double * sin(2 * a) + 0.05::double * f"),
        "moons": ("case k when 0 then cos(a) else 1 - cos(a) end + 0.05::double * e", "case k when 0 then sin(a) else 0.5 - sin(a) end + 0.05::double * f"),
    }.get(kind, (f"{cx} + {s} * e", f"{cy} + {s} * f"))
    if kind == "aniso":
        x, y = f"0.6::double * ({x}) - 0.6::double * ({y})", f"-0.4::double * ({x}) + 0.8::double * ({y})"
    return f"select '{kind}' as kind, pid, k as label, round({x}, 6) as x, round({y}, 6) as y from ({base})"


@query("gen_toy", " union all ".join(map(_toy_sql, _KINDS)))
def gen_toy(spark, sf):
    out = None
    for kind in _KINDS:
        one = formats.toy_shapes(spark, kind).select(F.lit(kind).alias("kind"), "pid", "label", *R6("x", "y"))
        out = one if out is None else out.unionByName(one)
    return out


# --- whole pipelines and engine extras --------------------------------------------------------------------------


@query("foreground_objects")
def foreground_objects(spark, sf):
    from pointmill.plans import pipelines

    return pipelines.foreground_objects(views.scan(spark, sf), eps=8.0, min_points=3)


@query("dataset_build")
def dataset_build(spark, sf):
    from pointmill.plans import pipelines

    b = views.with_3d(views.gt_boxes(spark, sf)).where("type <> 'DontCare'").withColumn("t2", F.lit(0.5)).withColumn("h", F.lit(3.0))
    return pipelines.build_objects(views.scan(spark, sf), b).groupBy("cls").agg(F.count("*").alias("n"), F.count_distinct("frame", "obj").alias("objects"))


@query("event_windows", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, sf):
    return frames.windowed(views.table(spark, sf, "events")).withColumn("total", F.round("total", 4))


@query("event_sessions", "with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as s from events), g as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) as n from g group by user_id, g")
def event_sessions(spark, sf):
    return frames.sessions(views.table(spark, sf, "events"))
