"""Filters, segments, downsampling and normalisation of point relations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ, gaussian
from pointmill.functions.tables import written
from pointmill.operators import spatial


def crop(df: DataFrame, strict: bool = True, **ranges: tuple[float | None, float | None]) -> DataFrame:
    """Rows inside all given ranges, e.g. y=(-15, 30); None leaves a side open."""
    for col, (low, high) in ranges.items():
        c = F.col(col)
        if low is not None:
            df = df.where(c > low if strict else c >= low)
        if high is not None:
            df = df.where(c < high if strict else c <= high)
    return df


def segment(df: DataFrame, bounds: Sequence[tuple[float, float]], col: str = "x") -> DataFrame:
    """Adds `seg`, the number of the open interval that holds the column; rows on a border are in none and dropped."""
    out = F.lit(None).cast("int")
    for i, (low, high) in reversed(list(enumerate(bounds))):
        out = F.when((F.col(col) > low) & (F.col(col) < high), i).otherwise(out)
    return df.withColumn("seg", out).where(F.col("seg").isNotNull())


def segment_uniform(df: DataFrame, n: int, col: str = "x") -> DataFrame:
    """Segments of equal width between the least and greatest value, borders dropped."""
    row = df.agg(F.min(col).alias("a"), F.max(col).alias("b")).first()
    if row["a"] is None:
        return df.withColumn("seg", F.lit(None).cast("int"))
    step = (row["b"] - row["a"]) / n
    return segment(df, [(row["a"] + i * step, row["a"] + (i + 1) * step) for i in range(n)], col)


def segment_half(df: DataFrame, at: float = 0.0, col: str = "x") -> DataFrame:
    """seg 0: at or above, 1: below."""
    return df.withColumn("seg", F.when(F.col(col) >= at, 0).otherwise(1))


def voxel(df: DataFrame, leaf: float, mode: str = "centroid", key: Sequence[str] = (), cols: Sequence[str] = XYZ, id: str = "pid", origin: str = "min", seed: int = 0, values: Sequence[str] = ()) -> DataFrame:
    """One row for each voxel: the mean of its points (and of `values`), or one of its rows at random.

    origin "min" anchors the grid at the least coordinates, "zero" at the origin.
    """
    if origin == "min":
        low = df.agg(*[F.min(c).alias(c) for c in cols]).first()
        base = {c: low[c] or 0.0 for c in cols}
    else:
        base = dict.fromkeys(cols, 0.0)
    h = [F.floor((F.col(c) - base[c]) / leaf).cast("long").alias(f"h{c}") for c in cols]
    cells = [f"h{c}" for c in cols]
    put = df.select("*", *h)
    if mode == "centroid":
        return put.groupBy(*key, *cells).agg(*[F.avg(c).alias(c) for c in (*cols, *values)], F.count("*").alias("n"))
    draw = F.struct(((F.col(id) * 7919 + seed) % 1000003).alias("r"), F.col(id).alias("i"))
    return put.groupBy(*key, *cells).agg(F.min_by(id, draw).alias(id), *[F.min_by(c, draw).alias(c) for c in cols])


def normalize(df: DataFrame, key: Sequence[str], scale: str | None = None, cols: Sequence[str] = XYZ) -> DataFrame:
    """Columns minus their mean in the key; scale "unit" divides by the greatest radius, "std" each column by its deviation."""
    stats = df.groupBy(*key).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    out = df.join(stats, list(key)) if key else df.join(F.broadcast(stats), F.lit(True))  # without a key the statistics are one row
    rest = [c for c in df.columns if c not in cols]
    moved = {c: F.col(c) - F.col(f"_m{i}") for i, c in enumerate(cols)}
    if scale == "std":
        moved = {c: F.try_divide(x, F.col(f"_s{i}")) for i, (c, x) in enumerate(moved.items())}
    out = out.select(*rest, *[x.alias(c) for c, x in moved.items()])
    if scale == "unit":
        size = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
        top = out.groupBy(*key).agg(F.max(size).alias("_r"))
        out = out.join(top, list(key)).select(*rest, *[F.try_divide(F.col(c), F.col("_r")).alias(c) for c in cols])
    return out.select(*df.columns)


def statistical_outlier(df: DataFrame, k: int = 20, ratio: float = 1.5, key: Sequence[str] = (), id: str = "pid") -> DataFrame:
    """Rows whose mean distance to k neighbours (itself among them) is at most mean + ratio * deviation of all."""
    near = spatial.knn(df, df, k, key=key, qid=id, bid=id).groupBy(*key, "qid").agg(F.avg("dist").alias("_d"))
    stats = near.groupBy(*key).agg((F.avg("_d") + ratio * F.stddev_samp("_d")).alias("_limit"))
    kept = (near.join(stats, list(key)) if key else near.join(F.broadcast(stats), F.lit(True))).where("_limit is null or _d <= _limit")
    return df.join(kept.select(*key, F.col("qid").alias(id)), [*key, id], "left_semi")


def bilateral(px: DataFrame, field: str = "depth", radius: int = 1, sigma_space: float = 1.0, sigma_value: float = 1.0, guide: str | None = None, key: Sequence[str] = ("frame",)) -> DataFrame:
    """(key.., u, v, field): weighted mean over the window; weights fall with distance and with the guide's difference."""
    guide = guide or field
    steps = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    spread = px.select(*key, "u", "v", F.col(guide).alias("_g")).withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    there = px.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("u").alias("_u"), F.col("v").alias("_v"), F.col(field).alias("_f"), F.col(guide).alias("_h"))
    on = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("u") + F.col("du") == F.col("_u"), F.col("v") + F.col("dv") == F.col("_v")]
    w = gaussian(F.sqrt((F.col("du") * F.col("du") + F.col("dv") * F.col("dv")).cast("double")), sigma_space) * gaussian(F.col("_h") - F.col("_g"), sigma_value)
    return spread.join(there, on).groupBy(*key, "u", "v").agg((F.sum(w * F.col("_f")) / F.sum(w)).alias(field))


def closing(px: DataFrame, pad: int = 1, field: str = "depth", key: Sequence[str] = ("frame",)) -> DataFrame:
    """Dilation then erosion by a square window; pixels without a row count as -1 in the erosion."""
    steps = F.array(*[F.lit(k) for k in range(-pad, pad + 1)])
    spread = lambda d: d.withColumn("du", F.explode(steps)).withColumn("dv", F.explode(steps))
    up = spread(px).groupBy(*key, (F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v")).agg(F.max(field).alias(field))
    down = spread(up).groupBy(*key, (F.col("u") + F.col("du")).alias("u"), (F.col("v") + F.col("dv")).alias("v")).agg(F.when(F.count("*") < (2 * pad + 1) ** 2, F.least(F.lit(-1.0), F.min(field))).otherwise(F.min(field)).alias(field))
    return px.select(*key, "u", "v").join(down, [*key, "u", "v"])


def normal_space(df: DataFrame, bins: int, n: int, key: Sequence[str] = (), id: str = "pid", seed: int = 0) -> DataFrame:
    """n rows whose normals are spread over bins: the first of every bin, then the second, and so on."""
    b = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) + 1) / 2 * bins)).cast("long")
    draw = (F.col(id) * 7919 + seed) % 1000003
    w = Window.partitionBy(*key, "_bx", "_by", "_bz").orderBy(draw, id)
    ranked = df.withColumn("_bx", b("nx")).withColumn("_by", b("ny")).withColumn("_bz", b("nz")).withColumn("_r", F.row_number().over(w))
    if key:
        over = Window.partitionBy(*key).orderBy("_r", "_bx", "_by", "_bz")
        out = ranked.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= n).drop("_n")
    else:
        out = ranked.orderBy("_r", "_bx", "_by", "_bz").limit(n)
    return out.drop("_bx", "_by", "_bz", "_r")


#: Rows of an object that is sampled inside a task; candidates that a larger one sends in each round.
FPS_ROWS, FPS_CANDIDATES = 100_000, 512


def fps(df: DataFrame, n: int, key: Sequence[str], id: str = "pid", rows: int = FPS_ROWS, candidates: int = FPS_CANDIDATES) -> DataFrame:
    """Farthest point sampling inside each key: (key.., step, id); starts at the least id, ties to the lower id.

    Objects of at most `rows` rows are sampled inside a task, larger ones in rounds over a written distance column; both give the
    same rows.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    large = written(sizes.select(*key, "_n"), "large")
    if large.isEmpty():
        return _fps_in_task(df, n, key, id)
    on = list(key)
    few = _fps_in_task(df.join(large, on, "left_anti"), n, key, id)
    return few.unionByName(_fps_in_rounds(df.join(large, on).select(*key, id, *XYZ, F.least(F.col("_n"), F.lit(n)).alias("_n")), on, id, candidates).select(*few.columns))


def _fps_in_task(df: DataFrame, n: int, key: Sequence[str], id: str) -> DataFrame:
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in (*key, id))
    names = [c for c in df.columns if c in (*key, id)]

    def pick(k, frame):
        frame = frame.sort_values(id)
        p = frame[list(XYZ)].to_numpy(float)
        far, chosen, at = np.full(len(p), 1e10), [], 0
        for _ in range(min(n, len(p))):
            chosen.append(at)
            far = np.minimum(far, ((p - p[at]) ** 2).sum(1))
            at = int(np.argmax(far))
        return frame.iloc[chosen][names].assign(step=range(len(chosen)))[[*names, "step"]]

    return df.select(*names, *XYZ).groupBy(*key).applyInPandas(pick, f"{fields}, step int")


def _fps_in_rounds(df: DataFrame, key: list[str], id: str, candidates: int) -> DataFrame:
    """(key.., step, id) of objects (key.., id, x, y, z, _n), _n samples each.

    A round sends the rows farthest from the samples so far. Among them sampling goes on as long as the farthest one, after the
    round's samples, is still beyond the last one sent: all other rows are nearer. Then all rows learn the round's samples.
    """
    fields = ", ".join(f"{c} {t}" for c, t in df.dtypes if c in (*key, id))

    def go_on(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_d", id], ascending=[False, True])
        p, d, ids = frame[list(XYZ)].to_numpy(float), frame["_d"].to_numpy(), frame[id].to_numpy()
        order = np.argsort(ids, kind="stable")  # the first of equals has the least id
        last, left, chosen = (d[-1], ids[-1]), int(frame["_n"].iloc[0] - frame["_step"].iloc[0]), []
        while len(chosen) < left:
            at = order[int(np.argmax(d[order]))]
            if len(frame) == candidates and (d[at], -ids[at]) < (last[0], -last[1]):
                break
            chosen.append(at)
            d = np.minimum(d, ((p - p[at]) ** 2).sum(1))
        return frame.iloc[chosen][[*key, id, *XYZ]].assign(step=np.arange(len(chosen), dtype=np.int32) + int(frame["_step"].iloc[0]))

    now, steps, out = written(df.withColumn("_d", F.lit(1e10)).withColumn("_step", F.lit(0)), "far"), f"{fields}, x double, y double, z double, step int", None
    w = Window.partitionBy(*key).orderBy(F.desc("_d"), id)
    while True:
        top = now.where("_step < _n").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= candidates).drop("_r")
        if out is None:  # all are equally far from no sample: the least id alone
            top = top.withColumn("_n", F.lit(1))
        new = written(top.groupBy(*key).applyInPandas(go_on, steps), "samples")
        if new.isEmpty():
            return out
        out = new.select(*key, id, "step") if out is None else out.unionByName(new.select(*key, id, "step"))
        told = new.groupBy(*key).agg((F.max("step") + 1).alias("_s"), F.collect_list(F.struct(*XYZ)).alias("_p"))  # `candidates` at most
        here = [F.col(c) for c in XYZ]
        near = F.array_min(F.transform("_p", lambda p: sum(((c - p[k]) * (c - p[k]) for c, k in zip(here, XYZ, strict=True)), F.lit(0.0))))
        moved = now.join(told, key, "left")
        now = written(moved.select(*key, id, *XYZ, "_n", F.least("_d", F.coalesce(near, F.col("_d"))).alias("_d"), F.coalesce("_s", "_step").alias("_step")), "far")


def resample(df: DataFrame, n: int, key: Sequence[str], id: str = "pid") -> DataFrame:
    """(key.., slot, id): n rows of each key, by farthest points from larger ones, by cycling through smaller ones."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"))
    large = df.join(sizes.where(F.col("_n") > n), list(key), "left_semi")
    w = Window.partitionBy(*key).orderBy(id)
    few = df.join(sizes.where(F.col("_n") <= n), list(key)).withColumn("_i", F.row_number().over(w) - 1)
    repeated = few.withColumn("slot", F.explode(F.sequence(F.col("_i").cast("long"), F.lit(n - 1).cast("long"), F.col("_n")))).select(*key, F.col("slot").cast("int").alias("slot"), id)
    return fps(large, n, key, id).select(*key, F.col("step").alias("slot"), id).unionByName(repeated)


def backproject(px: DataFrame, fx: float, fy: float, cx: float, cy: float, scale: float = 1000.0, trunc: float = 50.0) -> DataFrame:
    """Depth pixels as points; zero depth and depth beyond `trunc` have none."""
    z = F.col("depth") / scale
    return px.select("*", ((F.col("u") - cx) * z / fx).alias("x"), ((F.col("v") - cy) * z / fy).alias("y"), z.alias("z")).where((F.col("z") > 0) & (F.col("z") < trunc))


def zero_count(df: DataFrame, field: str) -> DataFrame:
    """The smallest distinct value and how often it occurs."""
    return df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy("value").limit(1)


def column_range_predicate(point: Sequence[Column], low: Sequence[float], high: Sequence[float]) -> Column:
    """Whether a point is in a closed box."""
    out = F.lit(True)
    for p, a, b in zip(point, low, high, strict=True):
        out = out & (p >= a) & (p <= b)
    return out
