"""Queries of the point networks, with small layers so that SQL can follow them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pointmill.functions.tables import shared_dir
from pointmill.operators import networks
from pointmill.plans import views
from pointmill.plans.registry import query

_INPUT = {"point": networks.drawn(3, (6, 8), 11), "object": networks.drawn(8, (6, 9), 12)}
_NET = {"input": _INPUT, "first": networks.drawn(3, (4,), 13), "feature": {"point": networks.drawn(4, (6,), 14), "object": networks.drawn(6, (16,), 15)}, "rest": networks.drawn(4, (6, 8), 16), "head": networks.drawn(8, (6, 5), 17)}
_SINGLE = {"rounds": [(24, [(1.5, 8, networks.drawn(3, (8, 8), 21))]), (8, [(2.5, 6, networks.drawn(11, (8, 12), 22))])], "whole": networks.drawn(15, (16,), 23), "head": networks.drawn(16, (8, 4), 24)}
_MULTI = {"rounds": [(16, [(1.0, 4, networks.drawn(3, (6,), 31)), (2.0, 8, networks.drawn(3, (8,), 32))]), (6, [(1.5, 4, networks.drawn(17, (6,), 33)), (3.0, 6, networks.drawn(17, (8,), 34))])], "whole": networks.drawn(17, (16,), 35), "head": networks.drawn(16, (4,), 36), "features_first": True}


def _points(spark, sf):
    return views.pts3(spark, sf).select("frame", "pid", F.array("x", "y", "z").alias("f"))


# --- SQL of layers: a step for each, columns named by its letter and place ---------------------------


def _step(name: str, source: str, inputs: list[str], layer: networks.Dense, keep: str, relu: bool = True, add: list[float] | None = None) -> tuple[str, list[str]]:
    out = [f"{name}{i}" for i in range(len(layer.bias))]
    sums = [" + ".join([f"{c} * ({w})::double" for c, w in zip(inputs, row, strict=True)] + [f"({b + (add[i] if add else 0)})::double"]) for i, (row, b) in enumerate(zip(layer.weight, layer.bias, strict=True))]
    return f"{name} as (select {keep}, {', '.join(f'greatest(0, {s}) as {o}' if relu else f'{s} as {o}' for s, o in zip(sums, out, strict=True))} from {source})", out


def _chain(name: str, source: str, inputs: list[str], layers, keep: str, last: bool = True, add=None) -> tuple[list[str], str, list[str]]:
    parts = []
    for k, layer in enumerate(layers):
        final = k == len(layers) - 1
        part, inputs = _step(f"{name}{'abcdefgh'[k]}", source, inputs, layer, keep, last or not final, add if final else None)
        parts.append(part)
        source = f"{name}{'abcdefgh'[k]}"
    return parts, source, inputs


def _pool(name: str, source: str, cols: list[str]) -> str:
    return f"{name} as (select frame, {', '.join(f'max({c}) as {c}' for c in cols)} from {source} group by frame)"


def _turn_sql(name: str, source: str, inputs: list[str], net: dict, k: int) -> tuple[list[str], str, list[str]]:
    one = [float(i // k == i % k) for i in range(k * k)]
    parts, now, cols = _chain(f"{name}p", source, inputs, net["point"], "frame, pid")
    parts.append(_pool(f"{name}m", now, cols))
    more, now, cols = _chain(f"{name}o", f"{name}m", cols, net["object"], "frame", last=False, add=one)
    return [*parts, *more], now, cols


def _moved_sql(name: str, source: str, inputs: list[str], turn: str, cells: list[str]) -> tuple[str, list[str]]:
    k = len(inputs)
    out = [f"{name}{j}" for j in range(k)]
    sums = [" + ".join(f"{c} * {cells[i * k + j]}" for i, c in enumerate(inputs)) + f" as {out[j]}" for j in range(k)]
    return f"{name} as (select frame, pid, {', '.join(sums)} from {source} join {turn} using (frame))", out


def _encoder_sql() -> tuple[list[str], str, list[str], str, list[str]]:
    parts, turn, cells = _turn_sql("t", "pts3", ["x", "y", "z"], _NET["input"], 3)
    part, cols = _moved_sql("u", "pts3", ["x", "y", "z"], turn, cells)
    parts.append(part)
    more, now, cols = _chain("v", "u", cols, _NET["first"], "frame, pid")
    parts += more
    more, turn, cells = _turn_sql("w", now, cols, _NET["feature"], 4)
    parts += more
    part, cols = _moved_sql("q", now, cols, turn, cells)
    parts.append(part)
    more, now, cols = _chain("r", "q", cols, _NET["rest"], "frame, pid", last=False)
    parts += [*more, _pool("e", now, cols)]
    return parts, "e", cols, turn, cells


def _listed(cols: list[str]) -> str:
    return "[" + ", ".join(f"round({c}, 6)" for c in cols) + "]"


_rounded = lambda col: F.transform(col, lambda v: F.round(v, 6))

_TURN = _turn_sql("t", "pts3", ["x", "y", "z"], _INPUT, 3)
_ENCODED = _encoder_sql()
_HEAD = _chain("h", "e", _ENCODED[2], _NET["head"], "frame", last=False)


@query("tnet_3d", f"with {', '.join(_TURN[0])} select frame, {_listed(_TURN[2])} as t from {_TURN[1]}")
def tnet_3d(spark, sf):
    return networks.transform_net(_points(spark, sf), ("frame",), _INPUT, 3).select("frame", _rounded("t").alias("t"))


@query("tnet_kd", f"with {', '.join(_ENCODED[0])} select frame, {_listed(_ENCODED[4])} as t from {_ENCODED[3]}")
def tnet_kd(spark, sf):
    return networks.encode(_points(spark, sf), ("frame",), _NET)[2].select("frame", _rounded("t").alias("t"))


@query("pointnet_encoder", f"with {', '.join(_ENCODED[0])} select frame, {_listed(_ENCODED[2])} as f from e")
def pointnet_encoder(spark, sf):
    return networks.encode(_points(spark, sf), ("frame",), _NET)[0].select("frame", _rounded("f").alias("f"))


def _term_sql() -> str:
    parts, turn, t = _TURN
    cells = []
    for i in range(3):
        for j in range(3):
            cells.append("power(" + " + ".join(f"{t[3 * i + m]} * ({t[3 * j + m]} - {float(j == m)}::double)" for m in range(3)) + ", 2)")
    return f"with {', '.join(parts)} select round(avg(sqrt({' + '.join(cells)})), 6) as term from {turn}"


@query("ortho_regularizer", _term_sql())
def ortho_regularizer(spark, sf):
    return networks.orthogonality(networks.transform_net(_points(spark, sf), ("frame",), _INPUT, 3), 3).select(F.round("term", 6).alias("term"))


_SCORES = ", ".join(f"{c} - ln({' + '.join(f'exp({d})' for d in _HEAD[2])}) as s{i}" for i, c in enumerate(_HEAD[2]))


_POINTNET = f"with {', '.join([*_ENCODED[0], *_HEAD[0]])}, z as (select frame, {_SCORES} from {_HEAD[1]}) select frame, {_listed([f's{i}' for i in range(len(_HEAD[2]))])} as scores, (list_position([{', '.join(f's{i}' for i in range(len(_HEAD[2])))}], greatest({', '.join(f's{i}' for i in range(len(_HEAD[2])))})) - 1)::int as prediction from z"


@query("model_pointnet", _POINTNET)
def model_pointnet(spark, sf):
    return networks.pointnet(_points(spark, sf), ("frame",), _NET).select("frame", _rounded("scores").alias("scores"), "prediction")


@query("model_scorer", _POINTNET)
def model_scorer(spark, sf):
    """The same network by its name, with the weights of a written table."""
    path = f"{shared_dir(spark).rstrip('/')}/weights-{uuid.uuid4().hex}"
    networks.save(spark, _NET, path)
    return networks.classify(views.pts3(spark, sf), ("frame",), "pointnet", path).select("frame", _rounded("scores").alias("scores"), "prediction")


@query("model_ssg")
def model_ssg(spark, sf):
    return networks.grouped_classifier(views.pts3(spark, sf), ("frame",), _SINGLE)


@query("model_msg")
def model_msg(spark, sf):
    return networks.grouped_classifier(views.pts3(spark, sf), ("frame",), _MULTI)
