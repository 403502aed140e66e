"""Oriented boxes: corners, projections, the points inside, overlaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.folds import CELLS, folded, for_parts, parts
from pointmill.functions.geometry import wrap_to_pi

#: Signs of (length, height, width) of the eight corners: the bottom face, then the top face.
CORNERS = [(1, 0, 1), (1, 0, -1), (-1, 0, -1), (-1, 0, 1), (1, -1, 1), (1, -1, -1), (-1, -1, -1), (-1, -1, 1)]


def front_point(df: DataFrame) -> DataFrame:
    """Adds fx, fy, fz: the centre moved half a length along the heading."""
    return df.select("*", (F.col("t1") + F.col("l") / 2 * F.cos(-F.col("ry"))).alias("fx"), F.col("t2").alias("fy"), (F.col("t3") + F.col("l") / 2 * F.sin(-F.col("ry"))).alias("fz"))


def corners(df: DataFrame, key: Sequence[str] = ("frame", "ord")) -> DataFrame:
    """(key.., corner, x, y, z): the eight corners in the camera's frame, y down, rotated by ry."""
    c, s = F.cos("ry"), F.sin("ry")
    points = []
    for i, (a, b, d) in enumerate(CORNERS):
        x, y, z = F.col("l") * (a / 2), F.col("h") * float(b), F.col("w") * (d / 2)
        points.append(F.struct(F.lit(i).alias("corner"), (c * x + s * z + F.col("t1")).alias("x"), (y + F.col("t2")).alias("y"), (c * z - s * x + F.col("t3")).alias("z")))
    return df.select(*key, F.explode(F.array(*points)).alias("_p")).select(*key, "_p.*")


def project_points(df: DataFrame, p: Sequence[Sequence[float]]) -> DataFrame:
    """Adds u, v: image coordinates by a 3x4 projection."""
    row = [F.col("x") * p[i][0] + F.col("y") * p[i][1] + F.col("z") * p[i][2] + p[i][3] for i in range(3)]
    return df.select("*", F.try_divide(row[0], row[2]).alias("u"), F.try_divide(row[1], row[2]).alias("v"))


def project(df: DataFrame, p: Sequence[Sequence[float]], key: Sequence[str] = ("frame", "ord"), near: float = 0.1) -> DataFrame:
    """Corners with image coordinates; a box with a corner nearer than `near` has none."""
    all_ = corners(df, key)
    ahead = all_.groupBy(*key).agg(F.min("z").alias("_z")).where(F.col("_z") >= near)
    return project_points(all_.join(ahead.select(*key), list(key), "left_semi"), p)


def orientation(df: DataFrame, p: Sequence[Sequence[float]], key: Sequence[str] = ("frame", "ord"), near: float = 0.1) -> DataFrame:
    """(key.., end, x, y, z, u, v): the heading from the centre to one length ahead; none if an end is nearer than `near`."""
    c, s = F.cos("ry"), F.sin("ry")
    ends = [F.struct(F.lit(i).alias("end"), (c * F.col("l") * i + F.col("t1")).alias("x"), F.col("t2").alias("y"), (-s * F.col("l") * i + F.col("t3")).alias("z")) for i in (0, 1)]
    whole = df.select(*key, F.array(*ends).alias("_e")).where(F.array_min(F.transform("_e", lambda e: e["z"])) >= near)
    return project_points(whole.select(*key, F.explode("_e").alias("_p")).select(*key, "_p.*"), p)


def wrap(df: DataFrame, col: str) -> DataFrame:
    """The angle column in [-pi, pi]."""
    return df.withColumn(col, wrap_to_pi(F.col(col)))


def points_in(points: DataFrame, boxes: DataFrame, inflate: Sequence[float] = (1.15, 1.25, 1.0), key: Sequence[str] = ("frame",), box: str = "ord", id: str = "pid") -> DataFrame:
    """(key.., pid, box): points inside each box of their frame, its length, width and height inflated.

    Points and boxes meet in cells of the ground plane. A box lies in cells of its own size (the power of two at or above its longer
    side), nine at most; a point is put once in a cell of each size that its frame has boxes of, so a wide box costs the others nothing.
    """
    fl, fw, fh = inflate
    half_l, half_w = F.col("l") * (fl / 2), F.col("w") * (fw / 2)
    turn_c, turn_s = F.abs(F.cos("ry")), F.abs(F.sin("ry"))
    reach = {"t1": turn_c * half_l + turn_s * half_w, "t3": turn_s * half_l + turn_c * half_w}
    edge = F.pow(F.lit(2.0), F.col("_e"))
    cell = lambda c: F.floor(c / edge).cast("long")
    slack = 1e-9  # rounding doesn't put a point on the border beside its box
    spread = lambda t: F.explode(F.sequence(cell(F.col(t) - reach[t] * (1 + slack) - F.abs(F.col(t)) * slack), cell(F.col(t) + reach[t] * (1 + slack) + F.abs(F.col(t)) * slack)))
    sized = boxes.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(box).alias("box"), "t1", "t2", "t3", "l", "w", "h", "ry", F.ceil(F.log2(F.greatest(2 * half_l, 2 * half_w, F.lit(1e-6)))).cast("int").alias("_e"))
    b = sized.withColumn("_i", spread("t1")).withColumn("_j", spread("t3")).withColumnRenamed("_e", "_size")
    sizes = sized.select(*[F.col(f"_{k}").alias(k) for k in key], "_e").distinct()
    few = sizes.groupBy(*key).agg(F.collect_set("_e").alias("_all"))  # as many as powers of two between the smallest and the largest box
    p = points.join(few, list(key)) if key else points.join(F.broadcast(few), F.lit(True))
    p = p.withColumn("_e", F.explode("_all")).select(*key, id, "x", "y", "z", "_e", cell(F.col("x")).alias("_pi"), cell(F.col("z")).alias("_pj"))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("_e") == F.col("_size"), F.col("_pi") == F.col("_i"), F.col("_pj") == F.col("_j")]
    dx, dy, dz = F.col("x") - F.col("t1"), F.col("y") - F.col("t2"), F.col("z") - F.col("t3")
    c, s = F.cos("ry"), F.sin("ry")
    along, across = c * dx - s * dz, s * dx + c * dz
    inside = (F.abs(along) <= F.col("l") * (fl / 2)) & (F.abs(across) <= F.col("w") * (fw / 2)) & (dy <= 0) & (dy >= -F.col("h") * fh)
    return p.join(b, on).where(inside).select(*key, id, "box")


def to_lidar(df: DataFrame, calib: DataFrame, key: Sequence[str] = ("frame",), cols: Sequence[str] = ("t1", "t2", "t3")) -> DataFrame:
    """Adds lx, ly, lz = R^T p - R^T t with the calibration of the frame (columns r00..r22, tx, ty, tz)."""
    p = [F.col(c) for c in cols]
    j = df.join(calib, list(key))
    out = [sum((F.col(f"r{i}{k}") * (p[i] - F.col(t)) for i, t in enumerate(("tx", "ty", "tz"))), F.lit(0.0)).alias(n) for k, n in enumerate(("lx", "ly", "lz"))]
    return j.select(*[df[c] for c in df.columns], *out)


def iou_2d(a: str, b: str, criterion: int = -1) -> Column:
    """Overlap of two image boxes (structs or prefixes a_, b_): over the union, or over the first (0) or second (1)."""
    at = lambda p, c: F.col(f"{p}{c}")
    w = F.least(at(a, "x2"), at(b, "x2")) - F.greatest(at(a, "x1"), at(b, "x1"))
    h = F.least(at(a, "y2"), at(b, "y2")) - F.greatest(at(a, "y1"), at(b, "y1"))
    inter = w * h
    area = lambda p: (at(p, "x2") - at(p, "x1")) * (at(p, "y2") - at(p, "y1"))
    of = {-1: area(a) + area(b) - inter, 0: area(a), 1: area(b)}[criterion]
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(F.coalesce(F.try_divide(inter, of), F.lit(0.0)))


#: Edges within this distance of each other are one line.
TOUCH = 1e-9


def _footprint(p: str) -> Column:
    """The four ground corners of the box with the columns t1, t3, l, w, ry under a prefix, counter-clockwise."""
    at = lambda n: F.col(f"{p}{n}")
    c, s = F.cos(at("ry")), F.sin(at("ry"))
    local = [(at("l") * i / 2, at("w") * j / 2) for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))]
    return F.array(*[F.struct((c * x + s * y + at("t1")).alias("x"), (c * y - s * x + at("t3")).alias("y")) for x, y in local])


def _edges(corners: Column) -> Column:
    """(x, y, dx, dy, size) of each edge."""
    turn = F.concat(F.slice(corners, 2, 3), F.slice(corners, 1, 1))
    return F.zip_with(corners, turn, lambda p, q: F.struct(p["x"].alias("x"), p["y"].alias("y"), (q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy"), F.hypot(q["x"] - p["x"], q["y"] - p["y"]).alias("size")))


def _inside_part(edges: Column, others: Column, slack: float) -> Column:
    """Twice the area under the parts of the edges that lie left of all other edges, at most `slack` outside."""

    def cut(span: Column, o: Column, e: Column) -> Column:
        """The part lo..hi of an edge that is left of one other edge."""
        before = (o["dx"] * (e["y"] - o["y"]) - o["dy"] * (e["x"] - o["x"])) / o["size"] + slack
        rise = (o["dx"] * e["dy"] - o["dy"] * e["dx"]) / o["size"]
        flat = F.abs(rise) <= TOUCH
        # on one line, polygons on either side of it do not overlap
        outside = (before < 0) | ((o["dx"] * e["dx"] + o["dy"] * e["dy"] < 0) & (before < 2 * TOUCH))
        lo = F.when(~flat & (rise > 0), F.greatest(span["lo"], -before / rise)).when(flat & outside, 2.0).otherwise(span["lo"])
        hi = F.when(~flat & (rise < 0), F.least(span["hi"], -before / rise)).otherwise(span["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    def under(e: Column) -> Column:
        whole = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        # the cross product of the part's ends
        return F.aggregate(others, whole, lambda span, o: cut(span, o, e), lambda span: F.when(span["hi"] > span["lo"], (span["hi"] - span["lo"]) * (e["x"] * e["dy"] - e["y"] * e["dx"])).otherwise(0.0))

    return F.aggregate(F.transform(edges, under), F.lit(0.0), lambda total, x: total + x)


def ground_overlaps(pairs: DataFrame, a: str = "a_", b: str = "b_") -> DataFrame:
    """Adds `_flat`, the area in which two footprints overlap, and `_solid`, the volume; columns t1, t2, t3, h, w, l, ry under both prefixes.

    The border of the overlap of two convex polygons is what of each one's edges lies inside the other, and
    its area the sum of cross products along it. Edges that coincide count from the first polygon only.
    """
    at = lambda p, n: F.col(f"{p}{n}")
    real = (at(a, "l") > 0) & (at(a, "w") > 0) & (at(b, "l") > 0) & (at(b, "w") > 0)
    out = pairs.withColumn("_p", _edges(_footprint(a))).withColumn("_q", _edges(_footprint(b)))
    twice = _inside_part(F.col("_p"), F.col("_q"), TOUCH) + _inside_part(F.col("_q"), F.col("_p"), -TOUCH)
    flat = F.when(real, F.greatest(twice / 2, F.lit(0.0))).otherwise(0.0)
    high = F.least(at(a, "t2"), at(b, "t2")) - F.greatest(at(a, "t2") - at(a, "h"), at(b, "t2") - at(b, "h"))
    return out.withColumn("_flat", flat).drop("_p", "_q").withColumn("_solid", F.col("_flat") * F.greatest(high, F.lit(0.0)))


def ground_ratio(kind: str, criterion: int = -1, a: str = "a_", b: str = "b_") -> Column:
    """The overlap of ground_overlaps() over the union, or over the first (0) or second (1) box; kind "bev" or "3d"."""
    size = lambda p: F.col(f"{p}l") * F.col(f"{p}w") * (F.col(f"{p}h") if kind == "3d" else F.lit(1.0))
    shared = F.col("_flat" if kind == "bev" else "_solid")
    of = {-1: size(a) + size(b) - shared, 0: size(a), 1: size(b)}[criterion]
    return F.when(of > 0, shared / of).otherwise(0.0)


def match_pairs(det: DataFrame, gt: DataFrame, cols: Sequence[str], key: Sequence[str] = ("frame",)) -> DataFrame:
    """All detection and truth pairs of a frame: a_ columns of the detection, b_ of the truth. A frame's boxes are few."""
    d = det.select(*key, *[F.col(c).alias(f"a_{c}") for c in cols])
    g = gt.select(*key, *[F.col(c).alias(f"b_{c}") for c in cols])
    return d.join(g, list(key))


# --- overlaps in blocks ------------------------------------------------------------------

#: Boxes of a frame that a task holds at a time; pairs whose footprints it measures at a time.
PART, GROUND_ROWS = 8192, 10_000
IMAGE, GROUND = ("x1", "y1", "x2", "y2"), ("t1", "t2", "t3", "h", "w", "l", "ry")


def _edges_of(t1: np.ndarray, t3: np.ndarray, l: np.ndarray, w: np.ndarray, ry: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, dx, dy and size (4, n) of the edges of _footprint()."""
    c, s = np.cos(ry), np.sin(ry)
    x = np.stack([c * (l * i / 2) + s * (w * j / 2) + t1 for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    y = np.stack([c * (w * j / 2) - s * (l * i / 2) + t3 for i, j in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    dx, dy = np.roll(x, -1, 0) - x, np.roll(y, -1, 0) - y
    return x, y, dx, dy, np.hypot(dx, dy)


def _inside_of(edges: tuple[np.ndarray, ...], others: tuple[np.ndarray, ...], slack: float) -> np.ndarray:
    """_inside_part() of many pairs."""
    x, y, dx, dy, _ = edges
    lo, hi = np.zeros_like(x), np.ones_like(x)
    for k in range(4):
        ox, oy, odx, ody, size = (c[k] for c in others)
        before = (odx * (y - oy) - ody * (x - ox)) / size + slack
        rise = (odx * dy - ody * dx) / size
        flat = np.abs(rise) <= TOUCH
        outside = (before < 0) | ((odx * dx + ody * dy < 0) & (before < 2 * TOUCH))
        at = np.divide(-before, rise, out=np.zeros_like(rise), where=~flat)
        lo = np.where(~flat & (rise > 0), np.maximum(lo, at), np.where(flat & outside, 2.0, lo))
        hi = np.where(~flat & (rise < 0), np.minimum(hi, at), hi)
    return np.where(hi > lo, (hi - lo) * (x * dy - y * dx), 0.0).sum(0)


def flat_overlaps(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """`_flat` and `_solid` of ground_overlaps() for pairs of boxes given by arrays of GROUND."""
    real = (a[4] > 0) & (a[5] > 0) & (b[4] > 0) & (b[5] > 0)
    flat = np.zeros(len(real))
    some = np.flatnonzero(real)
    for at in np.split(some, range(GROUND_ROWS, some.size, GROUND_ROWS)):
        p, q = (_edges_of(x[0][at], x[2][at], x[5][at], x[4][at], x[6][at]) for x in (a, b))
        flat[at] = np.maximum((_inside_of(p, q, TOUCH) + _inside_of(q, p, -TOUCH)) / 2, 0.0)
    high = np.minimum(a[1], b[1]) - np.maximum(a[1] - a[3], b[1] - b[3])
    return flat, flat * np.maximum(high, 0.0)


def _image_found(a: Sequence[np.ndarray], b: Sequence[np.ndarray], tile: slice, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two sorted blocks that share an area."""
    d = lambda c: a[c][tile, None]
    e = lambda c: b[c][None, some]
    return np.nonzero((np.minimum(d(2), e(2)) > np.maximum(d(0), e(0))) & (np.minimum(d(3), e(3)) > np.maximum(d(1), e(1))))


def _ground_found(a: Sequence[np.ndarray], b: Sequence[np.ndarray], tile: slice, some: slice) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose centres are no farther apart than their half diagonals together."""
    half = lambda x, at: np.hypot(x[4][at], x[5][at]) / 2
    reach = (half(a, tile)[:, None] + half(b, some)[None]) * (1 + 1e-9) + 2 * TOUCH
    u, v = a[0][tile, None] - b[0][None, some], a[2][tile, None] - b[2][None, some]
    return np.nonzero(u * u + v * v <= reach * reach)


def _spans(x: Sequence[np.ndarray], image: bool) -> tuple[np.ndarray, np.ndarray]:
    if image:
        return x[0], x[2]
    half = np.hypot(x[4], x[5]) / 2 * (1 + 1e-9) + 2 * TOUCH
    return x[0] - half, x[0] + half


def close_pairs(a: Sequence[np.ndarray], b: Sequence[np.ndarray], image: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the boxes that may overlap, some at a time. Both are swept along one axis in tiles, so far ones don't meet."""
    keep = [np.flatnonzero(np.isfinite(np.sum([c for c in x], 0))) for x in (a, b)]
    (alow, ahigh), (blow, bhigh) = _spans(a, image), _spans(b, image)
    i, j = (k[np.argsort(low[k], kind="stable")] for k, low in zip(keep, (alow, blow), strict=True))
    if not i.size or not j.size:
        return
    sa, sb, alow, ahigh, blow = [c[i] for c in a], [c[j] for c in b], alow[i], ahigh[i], blow[j]
    widest = float((bhigh[j] - blow).max(initial=0.0))
    for s in range(0, i.size, 256):
        tile = slice(s, min(s + 256, i.size))
        first, end = np.searchsorted(blow, alow[s] - max(widest, 0.0) * (1 + 1e-9)), np.searchsorted(blow, ahigh[tile].max(), side="right")
        for t in range(int(first), int(end), CELLS // 256):
            some = slice(t, min(t + CELLS // 256, int(end)))
            u, v = (_image_found if image else _ground_found)(sa, sb, tile, some)
            if u.size:
                yield i[s + u], j[t + v]


def image_shares(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """iou_2d() over the union, the first and the second of pairs given by arrays of IMAGE."""
    w, h = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), np.minimum(a[3], b[3]) - np.maximum(a[1], b[1])
    inter, one, two = w * h, (a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1])
    ok = (w > 0) & (h > 0)
    return tuple(np.divide(inter, of, out=np.zeros(len(w)), where=ok & (of != 0)) for of in (one + two - inter, one, two))


def ground_shares(a: Sequence[np.ndarray], b: Sequence[np.ndarray], solid: bool) -> tuple[np.ndarray, ...]:
    """ground_ratio() over the union, the first and the second of pairs given by arrays of GROUND."""
    shared = flat_overlaps(a, b)[solid]
    one, two = (x[5] * x[4] * (x[3] if solid else 1.0) for x in (a, b))
    return tuple(np.divide(shared, of, out=np.zeros(len(shared)), where=of > 0) for of in (one + two - shared, one, two))


def shares(metric: str, a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Overlap over the union, the first and the second of pairs; metric image, bev or 3d."""
    return image_shares(a, b) if metric == "image" else ground_shares(a, b, metric == "3d")


class _Overlaps:
    """The detections of one part of a frame; truth boxes come by."""

    def __init__(self, metric: str, near: float | None, held: list[np.ndarray]) -> None:
        self.metric, self.near, self.ids, self.boxes = metric, near, held[0], held[1:]

    def add(self, columns: list[np.ndarray]) -> Iterator[dict]:
        if self.ids is None:
            return
        ids, other = columns[0], columns[1:]
        for i, j in close_pairs(self.boxes, other, self.metric == "image"):
            a, b = [c[i] for c in self.boxes], [c[j] for c in other]
            if self.near is not None:
                some = (np.abs(a[0] - b[0]) < self.near) & (np.abs(a[2] - b[2]) < self.near)
                i, j, a, b = i[some], j[some], [c[some] for c in a], [c[some] for c in b]
            over, first, second = shares(self.metric, a, b)
            some = np.flatnonzero(first > 0)
            yield {"det": self.ids[i[some]], "gt": ids[j[some]], "overlap": over[some], "first": first[some], "second": second[some]}

    def end(self) -> Iterator[dict]:
        return iter(())


def overlapping(det: DataFrame, gt: DataFrame, metric: str, key: Sequence[str] = ("frame",), near: float | None = None) -> DataFrame:
    """(key.., det, gt, overlap, first, second) of all pairs of a frame that overlap, over the union, the detection and the truth.

    metric image, bev or 3d; `near` bounds the distance of the centres along either ground axis. A task has a part of a frame's
    detections and meets the truth boxes of the frame as they come by, so a crowded frame is bounded in memory and dealt to many tasks.
    """
    cols = IMAGE if metric == "image" else GROUND
    row = lambda df: df.select(*key, F.col("ord").cast("long").alias("ord"), *[F.col(c).cast("double").alias(c) for c in cols])
    dealt, counts = parts(row(det), "ord", PART, key)
    fold = lambda k, held: _Overlaps(metric, near, held or [None])
    return folded([(dealt, ["ord", *cols]), (for_parts(row(gt), counts, key), ["ord", *cols])], [*key, "_part"], fold, "det long, gt long, overlap double, first double, second double").drop("_part")
