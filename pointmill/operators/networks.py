"""Forward passes of point networks over given weights: transform nets, encoder, classifiers.

Points carry their features in one array column; an object is the points of one key. Layers that are shared by
all points run on Arrow batches, whatever the objects; pooling takes maxima inside the tasks first, so an
object's points never meet as a group. Weights come from the caller; there is no training here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ
from pointmill.functions.tables import written
from pointmill.operators import layers as grouping


@dataclass
class Dense:
    """weight (outputs x inputs) and bias; a batch normalisation is folded in by normalised()."""

    weight: np.ndarray
    bias: np.ndarray

    def normalised(self, mean, variance, scale, shift, eps: float = 1e-5) -> Dense:
        """The layer followed by a batch normalisation with the given running values."""
        by = np.asarray(scale) / np.sqrt(np.asarray(variance) + eps)
        return Dense(self.weight * by[:, None], (self.bias - mean) * by + shift)


def drawn(inputs: int, widths: Sequence[int], seed: int) -> list[Dense]:
    """Layers of the given widths with weights drawn from a seed, rounded to six digits."""
    rng, out = np.random.default_rng(seed), []
    for n in widths:
        out.append(Dense(rng.normal(0, 1 / np.sqrt(inputs), (n, inputs)).round(6), rng.normal(0, 0.1, n).round(6)))
        inputs = n
    return out


def _stacked(rows) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(float)


def dense(df: DataFrame, layers: Sequence[Dense], col: str = "f", last: bool = True) -> DataFrame:
    """The column of features after the layers, with ReLU after each (after the last only if `last`)."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        m = _stacked(x)
        for k, layer in enumerate(layers):
            m = m @ layer.weight.T + layer.bias
            if last or k < len(layers) - 1:
                m = np.maximum(m, 0)
        return pd.Series(list(m))

    return df.withColumn(col, run(col))


def max_pool(df: DataFrame, key: Sequence[str], col: str = "f") -> DataFrame:
    """(key.., features): the greatest of each feature of an object's points."""
    key = list(key)
    some = df.select(*key, col)

    def top(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(*(k if isinstance(k, tuple) else (k,)), _stacked(g[col]).max(0)) for k, g in frame.groupby(key, sort=False, dropna=False)]
        return pd.DataFrame(rows, columns=[*key, col])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield top(frame)

    schema = some.schema
    return some.mapInPandas(partial, schema).groupBy(*key).applyInPandas(top, schema)


def transform_net(df: DataFrame, key: Sequence[str], net: dict, k: int, col: str = "f", out: str = "t") -> DataFrame:
    """(key.., matrix): a k x k transform of each object, as a flat array: point layers, pooling, object layers, plus identity."""
    pooled = dense(max_pool(dense(df, net["point"], col), key, col), net["object"], col, last=False)
    one = F.array(*[F.lit(float(i // k == i % k)) for i in range(k * k)])
    return pooled.select(*key, F.zip_with(F.col(col), one, lambda a, b: a + b).alias(out))


def transformed(df: DataFrame, matrices: DataFrame, key: Sequence[str], k: int, col: str = "f", by: str = "t") -> DataFrame:
    """The first k features as a row vector times the object's matrix; further features stay."""

    @F.pandas_udf("array<double>")
    def turn(x: pd.Series, t: pd.Series) -> pd.Series:
        m = _stacked(x)
        moved = np.einsum("ni,nij->nj", m[:, :k], _stacked(t).reshape(-1, k, k))
        return pd.Series(list(np.concatenate([moved, m[:, k:]], 1)))

    return df.join(matrices, list(key)).withColumn(col, turn(col, by)).drop(by)


def encode(df: DataFrame, key: Sequence[str], net: dict, col: str = "f") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(key.., features) of each object, its 3 x 3 transform, and its feature transform if the net has one.

    net: `input` (a transform net), `first`, `rest` (point layers, the last without ReLU), and perhaps `feature`.
    """
    turn = written(transform_net(df, key, net["input"], 3, col), "turns")
    now = dense(transformed(df, turn, key, 3, col), net["first"], col)
    more = None
    if "feature" in net:
        width = len(net["first"][-1].bias)
        now = written(now, "features")
        more = written(transform_net(now, key, net["feature"], width, col), "turns")
        now = transformed(now, more, key, width, col)
    return max_pool(dense(now, net["rest"], col, last=False), key, col), turn, more


def orthogonality(matrices: DataFrame, k: int, by: str = "t") -> DataFrame:
    """One row: the mean over all objects of the Frobenius norm of T (T^t - I), as the surveyed term has it."""

    @F.pandas_udf("double")
    def size(t: pd.Series) -> pd.Series:
        m = _stacked(t).reshape(-1, k, k)
        return pd.Series(np.linalg.norm(m @ (m.transpose(0, 2, 1) - np.eye(k)), axis=(1, 2)))

    return matrices.agg(F.avg(size(by)).alias("term"))


def log_softmax(col: str = "f") -> Column:
    """Scores as log probabilities."""
    top = F.array_max(col)
    total = F.log(F.aggregate(col, F.lit(0.0), lambda a, v: a + F.exp(v - top))) + top
    return F.transform(col, lambda v: v - total)


def classified(pooled: DataFrame, head: Sequence[Dense], key: Sequence[str], col: str = "f") -> DataFrame:
    """(key.., scores, prediction) from an object's features; ties go to the lower class."""
    out = dense(pooled, head, col, last=False).select(*key, log_softmax(col).alias("scores"))
    return out.withColumn("prediction", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))


def pointnet(df: DataFrame, key: Sequence[str], net: dict, col: str = "f") -> DataFrame:
    """The classifier: encoder, then the object layers `head`."""
    return classified(encode(df, key, net, col)[0], net["head"], key, col)


def abstracted(df: DataFrame, key: Sequence[str], n: int, scales: Sequence[tuple[float, int, Sequence[Dense]]], features_first: bool = False, id: str = "pid") -> DataFrame:
    """(key.., id, x, y, z, f): n farthest points; around each, for every (radius, size, layers), the pooled features.

    Rows have x, y, z and perhaps an array f. Several scales are concatenated in their order.
    """
    has = "f" in df.columns
    df = written(df, "points")
    out = None
    for s, (r, size, layers) in enumerate(scales):
        ball = grouping.sample_and_group(df.select(*key, id, *XYZ), n, r, size, key, id)
        place = F.array(*[F.col(f"d{c}") for c in XYZ])
        if has:
            ball = ball.join(df.select(*key, F.col(id).alias("nid"), "f"), [*key, "nid"])
            put = F.concat("f", place) if features_first else F.concat(place, "f")
        else:
            put = place
        pooled = max_pool(dense(ball.select(*key, "centre", put.alias("f")), layers), [*key, "centre"]).withColumnRenamed("f", f"f{s}")
        out = pooled if out is None else out.join(pooled, [*key, "centre"])
    out = out.select(*key, F.col("centre").alias(id), F.concat(*[F.col(f"f{s}") for s in range(len(scales))]).alias("f"))
    return df.select(*key, id, *XYZ).join(out, [*key, id])


def grouped_classifier(df: DataFrame, key: Sequence[str], net: dict, id: str = "pid") -> DataFrame:
    """(key.., scores, prediction) by two rounds of set abstraction and one over whole objects.

    net: `rounds`, each (n, scales) as in abstracted(); `whole` and `head` layers; `features_first`. With one
    scale a round this is the single-scale network, with several the multi-scale one.
    """
    now = df
    for n, scales in net["rounds"]:
        now = abstracted(now, key, n, scales, net.get("features_first", False), id)
    whole = now.select(*key, F.concat(F.array(*XYZ), "f").alias("f"))
    return classified(max_pool(dense(whole, net["whole"]), key), net["head"], key)


# --- models by name -------------------------------------------------------------------------------

#: name -> (rows of points, key, net) -> (key.., scores, prediction); rows have x, y, z and an id.
MODELS: dict[str, Callable[[DataFrame, Sequence[str], dict], DataFrame]] = {}


def model(name: str):
    """Register a classifier under its name."""

    def add(f):
        MODELS[name] = f
        return f

    return add


@model("pointnet")
def _pointnet(df: DataFrame, key: Sequence[str], net: dict) -> DataFrame:
    return pointnet(df.select(*key, F.array(*XYZ).alias("f")), key, net)


@model("ssg")
def _single_scale(df: DataFrame, key: Sequence[str], net: dict) -> DataFrame:
    return grouped_classifier(df, key, net)


@model("msg")
def _multi_scale(df: DataFrame, key: Sequence[str], net: dict) -> DataFrame:
    return grouped_classifier(df, key, net)


def _parts(net: dict, path: str = "") -> Iterator[tuple[str, object]]:
    """The layers and the settings of a net with their paths, as `rounds.0.1` for the second scale of the first round."""
    for name, value in net.items():
        here = f"{path}{name}"
        if name == "rounds":
            for i, (n, scales) in enumerate(value):
                yield f"{here}.{i}", [float(n)]
                for j, (r, size, layers) in enumerate(scales):
                    yield f"{here}.{i}.{j}", [float(r), float(size)]
                    yield f"{here}.{i}.{j}", layers
        elif isinstance(value, dict):
            yield from _parts(value, f"{here}.")
        else:
            yield here, value if isinstance(value, list) else [float(value)]


def save(spark: SparkSession, net: dict, path: str) -> None:
    """The net as a table (part, layer, row, column, value): column -1 is the bias, layer -1 a setting."""
    frames = []
    for part, values in _parts(net):
        for k, v in enumerate(values):
            if isinstance(v, Dense):
                m = np.column_stack([v.bias, v.weight])
                row, column = np.indices(m.shape)
                frames.append(pd.DataFrame({"part": part, "layer": k, "row": row.ravel(), "column": column.ravel() - 1, "value": m.ravel()}))
            else:
                frames.append(pd.DataFrame({"part": [part], "layer": [-1], "row": [k], "column": [0], "value": [float(v)]}))
    spark.createDataFrame(pd.concat(frames), "part string, layer int, row int, column int, value double").write.parquet(path)


def load(spark: SparkSession, path: str) -> dict:
    """The net of a weight table, which is of a model's size."""
    told = spark.read.parquet(path).toPandas().sort_values(["part", "layer", "row", "column"])
    net: dict = {}
    rounds: dict[tuple[int, ...], dict] = {}
    for part, rows in told.groupby("part", sort=False):
        settings = rows[rows["layer"] < 0]["value"].tolist()
        found = []
        for _, r in rows[rows["layer"] >= 0].groupby("layer"):
            m = r["value"].to_numpy().reshape(r["row"].max() + 1, -1)
            found.append(Dense(m[:, 1:].copy(), m[:, 0].copy()))
        if part.startswith("rounds."):
            rounds[tuple(map(int, part.split(".")[1:]))] = {"settings": settings, "layers": found}
        elif settings:
            net[part] = bool(settings[0])
        else:
            *above, name = part.split(".")
            place = net
            for a in above:
                place = place.setdefault(a, {})
            place[name] = found
    if rounds:
        scales = lambda i: [(v["settings"][0], int(v["settings"][1]), v["layers"]) for k, v in sorted(rounds.items()) if len(k) == 2 and k[0] == i]
        net["rounds"] = [(int(v["settings"][0]), scales(k[0])) for k, v in sorted(rounds.items()) if len(k) == 1]
    return net


def classify(df: DataFrame, key: Sequence[str], name: str, path: str) -> DataFrame:
    """(key.., scores, prediction) by the named model with the weights at a path."""
    if name not in MODELS:
        raise ValueError(f"no model {name!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[name](df, key, load(df.sparkSession, path))
