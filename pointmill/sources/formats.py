"""Readers and writers of point, mesh, label and registration files."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL = "type string, truncation double, occlusion int, alpha double, x1 double, y1 double, x2 double, y2 double, h double, w double, l double, t1 double, t2 double, t3 double, ry double"
DETECTION = f"{LABEL}, score double"
_STEM = r"([^/]*?)(?:\.[^./]*)?$"


def stem(path: str = "path") -> F.Column:
    """File name without folder and ending."""
    return F.regexp_extract(path, _STEM, 1)


# --- binary records ----------------------------------------------------------


def read_bin(spark: SparkSession, path: str, width: int = 4, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(frame, pid, names..) of files of little-endian f32 records of `width` numbers; an incomplete last record is dropped.

    names are the first columns of a record; pid is the record's number in its file.
    """
    files = spark.read.format("binaryFile").load(path).select(stem().alias("frame"), "content")
    schema = T.StructType([T.StructField("frame", T.StringType()), T.StructField("pid", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["frame"], f["content"], strict=True):
                n = len(content) // (4 * width)
                a = np.frombuffer(content, "<f4", n * width).reshape(n, width)
                yield pd.DataFrame({"frame": name, "pid": np.arange(n), **{c: a[:, i].astype(float) for i, c in enumerate(names)}})

    return files.mapInPandas(parse, schema)


def read_velodyne(spark: SparkSession, path: str, reflectance: bool = False) -> DataFrame:
    return read_bin(spark, path, 4, ("x", "y", "z", "reflectance") if reflectance else ("x", "y", "z"))


def read_bin_normals(spark: SparkSession, path: str) -> DataFrame:
    return read_bin(spark, path, 6, ("x", "y", "z", "nx", "ny", "nz"))


def read_object_bin(spark: SparkSession, path: str) -> DataFrame:
    """Three numbers a record; adds class and num from names like Class_frame_num."""
    out = read_bin(spark, path, 3)
    return out.select("*", F.split_part("frame", F.lit("_"), F.lit(1)).alias("cls"))


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """One file for each row, named by a column, written by the tasks through the store's own file system; (path, bytes)."""

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for f in frames:
            paths, sizes = [], []
            for n, c in zip(f[name], f[content], strict=True):
                data = c.encode() if isinstance(c, str) else bytes(c)
                with store.open_output_stream(f"{base}/{n}") as out:
                    out.write(data)
                paths.append(f"{base}/{n}")
                sizes.append(len(data))
            yield pd.DataFrame({"path": paths, "bytes": sizes})

    return df.select(name, content).mapInPandas(put, "path string, bytes long")


def as_bin(df: DataFrame, key: Sequence[str], id: str = "pid", cols: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(key.., content): each frame's or object's records as f32 bytes in order of id. A frame is one file, so one task's."""
    types = dict(df.dtypes)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(id)
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in key}, "content": [f[list(cols)].to_numpy("<f4").tobytes()]})

    return df.select(*key, id, *cols).groupBy(*key).applyInPandas(pack, ", ".join(f"{k} {types[k]}" for k in key) + ", content binary")


# --- text clouds and meshes ----------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(frame, line, text) of whole text files; lines numbered from 0."""
    whole = spark.read.text(path, wholetext=True).select(stem("_metadata.file_path").alias("frame"), "value")
    return whole.select("frame", F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where("trim(text) <> ''")


def read_csv(spark: SparkSession, path: str, names: Sequence[str] = ("x", "y", "z"), sep: str = ",", header: bool = False, least: int | None = None) -> DataFrame:
    """(frame, pid, names..): the first columns of separated rows of numbers; pid is the row's number in its file."""
    rows = _lines(spark, path).where(F.col("line") >= (1 if header else 0))
    parts = F.split(F.trim("text"), rf"\s*{sep}\s*" if sep != " " else r"\s+")
    return rows.select("frame", (F.col("line") - (1 if header else 0)).cast("long").alias("pid"), *[F.get(parts, i).try_cast("double").alias(n) if hasattr(F.col("text"), "try_cast") else F.get(parts, i).cast("double").alias(n) for i, n in enumerate(names)])


def read_counted(spark: SparkSession, path: str, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """A first line with the number of rows, then as many space-separated rows."""
    rows = _lines(spark, path)
    n = rows.where("line = 0").select(F.col("frame").alias("_f"), F.trim("text").cast("int").alias("_n"))
    parts = F.split(F.trim("text"), r"\s+")
    return rows.join(n, F.col("frame") == F.col("_f")).where("line > 0 and line <= _n").select("frame", (F.col("line") - 1).cast("long").alias("pid"), *[F.get(parts, i).cast("double").alias(c) for i, c in enumerate(names)])


def read_off(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(points (frame, pid, x, y, z), faces (frame, fid, v)) of OFF meshes; the counts may follow OFF on its line."""
    whole = spark.read.text(path, wholetext=True).select(stem("_metadata.file_path").alias("frame"), F.split(F.trim(F.regexp_replace("value", r"^\s*OFF\s*", "")), r"\s*\r?\n\s*").alias("lines"))
    counts = F.split(F.element_at("lines", 1), r"\s+")
    head = whole.select("frame", "lines", F.get(counts, F.lit(0)).cast("int").alias("n"), F.get(counts, F.lit(1)).cast("int").alias("m"))
    num = lambda i: F.get(F.split("text", r"\s+"), F.lit(i))
    points = head.select("frame", F.posexplode(F.slice("lines", F.lit(2), F.col("n"))).alias("pid", "text")).select("frame", F.col("pid").cast("long"), *[num(i).cast("double").alias(c) for i, c in enumerate("xyz")])
    faces = head.select("frame", F.posexplode(F.slice("lines", F.col("n") + 2, F.col("m"))).alias("fid", "text")).select("frame", F.col("fid").cast("long"), F.transform(F.slice(F.split("text", r"\s+"), 2, 3), lambda v: v.cast("int")).alias("v"))
    return points, faces


def off_text(points: DataFrame, faces: DataFrame, key: str = "frame") -> DataFrame:
    """(key, content) of OFF files."""
    p = points.groupBy(key).agg(F.count("*").alias("n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pid", F.concat_ws(" ", "x", "y", "z").alias("t")))), lambda s: s["t"])).alias("p"))
    f = faces.groupBy(key).agg(F.count("*").alias("m"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("fid", F.concat(F.lit("3 "), F.array_join(F.col("v").cast("array<string>"), " ")).alias("t")))), lambda s: s["t"])).alias("f"))
    return p.join(f, key, "left").select(key, F.concat_ws("\n", F.concat_ws(" ", F.lit("OFF"), F.lit(None)), F.concat_ws(" ", "n", F.coalesce("m", F.lit(0)), F.lit(0)), "p", F.coalesce("f", F.lit(""))).alias("content"))


def ply_bytes(points: DataFrame, key: str = "frame", normals: bool = False, faces: DataFrame | None = None) -> DataFrame:
    """(key, content) of binary little-endian PLY files: f4 vertices, i4[3] faces. A file is one task's."""
    cols = ["x", "y", "z", *(("nx", "ny", "nz") if normals else ())]
    kind = dict(points.dtypes)[key]
    both = points.select(key, F.lit(0).alias("_part"), F.col("pid").alias("_i"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_v"))
    if faces is not None:
        both = both.unionByName(faces.select(key, F.lit(1).alias("_part"), F.col("fid").alias("_i"), F.col("v").cast("array<double>").alias("_v")))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["_part", "_i"])
        points_, faces_ = f[f["_part"] == 0], f[f["_part"] == 1]
        head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(points_)}", *[f"property float {c}" for c in cols]]
        if len(faces_):
            head += [f"element face {len(faces_)}", "property list uchar int vertex_indices"]
        body = np.array(points_["_v"].tolist(), "<f4").tobytes()
        rows = np.zeros(len(faces_), np.dtype([("n", "u1"), ("v", "<i4", 3)]))
        rows["n"] = 3
        if len(faces_):
            rows["v"] = np.array(faces_["_v"].tolist())
        return pd.DataFrame({key: [f[key].iloc[0]], "content": ["\n".join([*head, "end_header", ""]).encode() + body + rows.tobytes()]})

    return both.groupBy(key).applyInPandas(pack, f"{key} {kind}, content binary")


#: PLY's names of number types.
_PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(content: bytes) -> pd.DataFrame:
    """The vertices of a PLY file, ascii or binary."""
    head, body = content.split(b"end_header", 1)
    body = body.lstrip(b"\r").removeprefix(b"\n")
    lines = [x.split() for x in head.decode("ascii", "replace").splitlines()]
    form = next(x[1] for x in lines if x[:1] == ["format"])
    n, props, inside = 0, [], False
    for x in lines:
        if x[:1] == ["element"]:
            if inside:
                break
            inside = x[1] == "vertex"
            n = int(x[2]) if inside else 0
        elif x[:1] == ["property"] and inside:
            props.append((x[2], _PLY_TYPES[x[1]]))
    if form == "ascii":
        rows = [r.split()[: len(props)] for r in body.decode().splitlines() if r.strip()][:n]
        return pd.DataFrame(np.array(rows, float).reshape(-1, len(props)), columns=[p for p, _ in props])
    order = "<" if "little" in form else ">"
    a = np.frombuffer(body, np.dtype([(p, order + t) for p, t in props]), n)
    return pd.DataFrame({p: a[p].astype(float) for p, _ in props})


def read_ply(spark: SparkSession, path: str, names: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(frame, pid, names..) of PLY vertices; a missing property is null."""
    files = spark.read.format("binaryFile").load(path).select(stem().alias("frame"), "content")
    schema = T.StructType([T.StructField("frame", T.StringType()), T.StructField("pid", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["frame"], f["content"], strict=True):
                v = parse_ply(bytes(content)).reindex(columns=list(names))
                yield v.assign(frame=name, pid=np.arange(len(v)))[["frame", "pid", *names]]

    return files.mapInPandas(parse, schema)


# --- labels, calibrations, lists -------------------------------------------------


def read_labels(spark: SparkSession, path: str, detections: bool = False) -> DataFrame:
    """(frame, ord, fields..): space-separated label (15) or detection (16) rows up to the first short one of a file."""
    fields = [f.strip().split(" ") for f in (DETECTION if detections else LABEL).split(",")]
    rows = _lines(spark, path).withColumn("_p", F.split(F.trim("text"), r"\s+"))
    short = F.size("_p") < len(fields)
    first = rows.groupBy("frame").agg(F.min(F.when(short, F.col("line"))).alias("_stop"))
    rows = rows.join(first, "frame").where("_stop is null or line < _stop")
    return rows.select("frame", F.col("line").cast("long").alias("ord"), *[F.get("_p", F.lit(i)).cast("double").cast(t).alias(n) if t != "string" else F.get("_p", F.lit(i)).alias(n) for i, (n, t) in enumerate(fields)])


def detection_flags(det: DataFrame, classes: Sequence[str] = ("Car", "Pedestrian", "Cyclist")) -> DataFrame:
    """One row: which classes have detections, and whether every detection has an orientation (alpha not -10)."""
    return det.agg(*[F.coalesce(F.bool_or(F.lower("type") == c.lower()), F.lit(False)).alias(f"has_{c.lower()}") for c in classes], F.coalesce(F.bool_and(F.col("alpha") != -10), F.lit(True)).alias("aos"))


def label_text(df: DataFrame, key: str = "frame", detections: bool = False) -> DataFrame:
    """(key, content): label files; angles wrapped to [-pi, pi], missing numbers -1, -10 (angles) or -1000 (places)."""
    from pointmill.functions.geometry import wrap_to_pi

    missing = {"truncation": -1.0, "occlusion": -1.0, "alpha": -10.0, "ry": -10.0, "t1": -1000.0, "t2": -1000.0, "t3": -1000.0}
    fields = [f.strip().split(" ")[0] for f in (DETECTION if detections else LABEL).split(",")]
    has = set(df.columns)

    def value(n: str):
        if n not in has:
            return F.lit(missing.get(n, -1.0))
        c = F.col(n).cast("double")
        return F.coalesce(wrap_to_pi(c) if n in ("alpha", "ry") else c, F.lit(missing.get(n, -1.0)))

    text = F.concat_ws(" ", F.col("type"), *[F.format_string("%d", value(n).cast("int")) if n == "occlusion" else F.format_string("%.2f", value(n)) for n in fields[1:]])
    return df.groupBy(key).agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))), lambda s: s["t"]), "\n"), F.lit("\n")).alias("content"))


def read_calibration(spark: SparkSession, path: str, line: int = 5) -> DataFrame:
    """(frame, r00..r22, tx, ty, tz) of a named 3x4 row; line 5 maps the scanner to the camera."""
    p = F.split(F.trim("text"), r"\s+")
    names = [f"r{i}{j}" if j < 3 else "t" + "xyz"[i] for i in range(3) for j in range(4)]
    rows = _lines(spark, path).where(F.col("line") == line)
    return rows.select("frame", *[F.get(p, F.lit(k + 1)).cast("double").alias(n) for k, n in enumerate(names)])


def read_pairs(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(target, source, t_x.., q_w..) of a registration list with a header; `skip` solved rows are left out."""
    names = ("target", "source", "t_x", "t_y", "t_z", "q_w", "q_x", "q_y", "q_z")
    rows = read_csv(spark, path, names, header=True).where(F.col("pid") >= skip)
    return rows.select(F.col("target").cast("int").alias("target"), F.col("source").cast("int").alias("source"), *names[2:])


def read_split(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """(name, cls[, label]) of a list of names; the class is what stands before the first underscore."""
    out = spark.read.text(path).where("trim(value) <> ''").select(F.trim("value").alias("name"), F.split_part(F.trim("value"), F.lit("_"), F.lit(1)).alias("cls"))
    return out.join(classes, "cls") if classes is not None else out


def associated(images: DataFrame, depths: DataFrame, cameras: DataFrame) -> DataFrame:
    """Image, depth and intrinsics files that belong together: their names agree but for the folder and the kind."""
    base = lambda c: F.regexp_replace(F.regexp_extract(c, _STEM, 1), "_(image|depth|camera)$", "")
    take = lambda d, n: d.select(base("path").alias("name"), F.col("path").alias(n))
    return take(images, "image").join(take(depths, "depth"), "name").join(take(cameras, "camera"), "name")


# --- generators ------------------------------------------------------------------


def uniform_points(spark: SparkSession, n: int, dims: int = 3, extent: float = 10.0) -> DataFrame:
    """(pid, x0..): points on a grid of thousandths of the extent, fixed by their id."""
    c = [((F.col("id") * (7919 + 2 * i) + i * 104729) % 1000 / 1000.0 * extent).alias(f"x{i}") for i in range(dims)]
    return spark.range(n).select(F.col("id").alias("pid"), *c)


def drawn(id: str, seed: int) -> Column:
    """A number from 0 to 1 for each id, the same on every run and however rows are dealt."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def gaussian(id: str, seed: int) -> Column:
    """A standard normal number for each id."""
    return F.sqrt(-2 * F.log(1 - drawn(id, 2 * seed))) * F.cos(2 * math.pi * drawn(id, 2 * seed + 1))


def gaussian_blobs(spark: SparkSession, sizes: Sequence[int] = (400, 600, 1000), means=((0.5, 0.5), (5.5, 2.5), (1.0, 7.0)), deviations=((1.0, 3.0), (2.0, 2.0), (6.0, 2.0)), seed: int = 1) -> DataFrame:
    """(pid, label, x, y) from Gaussians of the given sizes."""
    out, first = None, 0
    for k, n in enumerate(sizes):
        one = spark.range(first, first + n).select(F.col("id").alias("pid"), F.lit(k).alias("label"), *[(gaussian("id", seed + 2 * k + i) * deviations[k][i] + means[k][i]).alias(c) for i, c in enumerate("xy")])
        out, first = one if out is None else out.unionByName(one), first + n
    return out


def toy_shapes(spark: SparkSession, kind: str, n: int = 1500, noise: float = 0.05, seed: int = 1) -> DataFrame:
    """(pid, label, x, y): circles, moons, blobs, aniso or varied."""
    base = spark.range(n).select(F.col("id").alias("pid"), (F.col("id") % (2 if kind in ("circles", "moons") else 3)).cast("int").alias("label"), (drawn("id", seed) * math.pi).alias("_a"), gaussian("id", seed + 1).alias("_e"), gaussian("id", seed + 2).alias("_f"))
    k, a, e, f = F.col("label"), F.col("_a"), F.col("_e"), F.col("_f")
    if kind == "circles":
        r = F.when(k == 0, 1.0).otherwise(0.5)
        x, y = r * F.cos(2 * a) + noise * e, r * F.sin(2 * a) + noise * f
    elif kind == "moons":
        x = F.when(k == 0, F.cos(a)).otherwise(1 - F.cos(a)) + noise * e
        y = F.when(k == 0, F.sin(a)).otherwise(0.5 - F.sin(a)) + noise * f
    else:
        cx, cy = F.when(k == 0, -6.0).when(k == 1, 0.0).otherwise(6.0), F.when(k == 0, 2.0).when(k == 1, -5.0).otherwise(3.0)
        s = F.when(k == 0, 1.0).when(k == 1, 2.5).otherwise(0.5) if kind == "varied" else F.lit(1.0)
        x, y = cx + s * e, cy + s * f
        if kind == "aniso":
            x, y = 0.6 * x - 0.6 * y, -0.4 * x + 0.8 * y
    return base.select("pid", "label", x.alias("x"), y.alias("y"))


def numbered(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds pid: the row's place in its key."""
    return df.withColumn("pid", (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))
