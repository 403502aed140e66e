"""Near-duplicate embeddings by lattice hashing: cells of E8 points in several tables, neighbouring cells probed, cosine verified.

1. Equal vectors are one node with a count, so copies never meet each other.
2. Nodes in one cell of table 0 form balls around a mean direction. All nodes within half the wanted angle of
   the mean are linked with each other without a comparison, so a group of any number of close near copies costs its size. A
   crowded cell is dealt in parts, whose balls are merged in further rounds. A node near no other is a ball alone.
3. In every table a node's unit vector is projected at random and decoded to points of E8. A ball stands in the cells of its
   nodes ("home") and in the nearest neighbouring cells. Where one ball is at home in a cell of another, and 64 signs of
   their means are near enough for a link, the two are candidates: a pair of balls, once, not all pairs of nodes.
4. The means and radii decide most pairs (all nodes linked, or none); only balls between which some nodes
   may be linked are compared node by node, in blocks. A link is a cosine, in double precision, at or above the threshold.
5. Linked balls give the components.

Found links are all true; a pair at the threshold itself shares a cell with probability RECALL, closer ones sooner. Rows whose
vector is null, zero, or has null or non-finite entries have no links; a shorter vector is read as if zeros followed. Rows
that repeat an id are rows of their own; a row without an id keeps its links, a component is named by its least id
(null if it has none), and `kept` compares with null as a value. An empty table gives no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.graph import connected_components
from pointmill.functions.tables import written
from pointmill.llm import common, vectors

COSINE = 0.9
#: Tables, E8 points that name a cell, width of a cell (of unit vectors), neighbouring cells probed. Pairs of cosine 0.9 are found with RECALL.
TABLES, POINTS, WIDTH, PROBES, RECALL = 12, 2, 1.75, 4, 0.93
#: Nodes of a part of a cell; balls of a part of a bucket; nodes of a block of a ball.
PART, BUCKET_PART, BLOCK = 2000, 3000, 2000
#: Crowded cells whose table may be broadcast.
BROADCAST_ROWS = 10_000
#: Angles are compared with so much to spare, so that rounding never decides.
SPARE = 1e-6
SEED = 11


# --- the lattice ---------------------------------------------------------------


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of 1 or -1, or all of 1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for s in (1, -1):
            for t in (1, -1):
                v = np.zeros(8)
                v[i], v[j] = s, t
                out.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


NEIGHBOURS = _shortest()


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points of even sum: rounded, and if the sum is odd, the entry farthest from its rounding goes the other way."""
    out = np.rint(x)
    odd = np.flatnonzero(out.sum(1) % 2)
    off = x[odd] - out[odd]
    worst = np.abs(off).argmax(1)
    out[odd, worst] += np.where(off[np.arange(odd.size), worst] >= 0, 1.0, -1.0)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: even points, or even points moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def projections(d: int, table: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, d]).standard_normal((d, 8 * POINTS)) / WIDTH


def _named(points: np.ndarray, table: int) -> np.ndarray:
    """64 bits for each row of lattice points (times two: whole numbers) of a table."""
    out = common.mix64(np.full(len(points), table + 1, np.uint64))
    for c in (2 * points).astype(np.int64).astype(np.uint64).T:
        out = common.mix64(out * np.uint64(0x9E3779B97F4A7C15) + c)
    return out.view(np.int64)


def cells(unit: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """The cell of each unit vector, then those of its `probes` nearest neighbours, as columns."""
    at = unit @ projections(unit.shape[1], table)
    home = np.hstack([decode(at[:, k : k + 8]) for k in range(0, at.shape[1], 8)])
    out = [_named(home, table)]
    if probes:
        rest = at - home
        gain = np.hstack([rest[:, k : k + 8] @ NEIGHBOURS.T for k in range(0, at.shape[1], 8)])
        near = np.argpartition(-gain, probes, axis=1)[:, :probes]
        for p in near.T:
            moved = home.copy().reshape(len(home), -1, 8)
            moved[np.arange(len(home)), p // len(NEIGHBOURS)] += NEIGHBOURS[p % len(NEIGHBOURS)]
            out.append(_named(moved.reshape(home.shape), table))
    return np.stack(out, 1)


def signs(unit: np.ndarray) -> np.ndarray:
    """64 signs of random projections."""
    up = unit @ np.random.default_rng([SEED, 1 << 20, unit.shape[1]]).standard_normal((unit.shape[1], 64)) >= 0
    return (up.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def signs_apart(angle: np.ndarray) -> np.ndarray:
    """Signs by which vectors at an angle differ at most, five standard deviations to the safe side."""
    p = np.minimum(angle, math.pi / 2) / math.pi
    return 64 * p + 5 * np.sqrt(64 * p * (1 - p))


# --- balls ----------------------------------------------------------------------


def _units(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        x = x / np.abs(x).max(1, keepdims=True, initial=1e-300)  # no overflow in squares
        return x / np.sqrt((x * x).sum(1, keepdims=True))


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which unit vectors have a cosine of `least`; values that rounding could turn are summed exactly."""
    s = a @ b.T
    out = s >= least
    for i, j in zip(*np.nonzero(np.abs(s - least) < 1e-13 * max(1, a.shape[1])), strict=True):
        out[i, j] = math.fsum((a[i] * b[j]).tolist()) >= least
    return out


def gather(unit: np.ndarray, radius: np.ndarray, weight: np.ndarray, least: float, loose: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Balls among the items of one cell: each item's ball (the place of its first item), whether the ball is tight, and the
    weight of the items of its own ball that an item is linked with (for tight balls all others).

    Items are nodes or, with radius, tight balls of them; `loose` lets nodes that are linked with one node, but too wide for a tight
    ball, form a ball in which links are counted one by one.
    """
    n, half = len(unit), math.acos(least) / 2 - SPARE
    ball, tight, inside = np.arange(n), np.ones(n, bool), np.zeros(n)
    free = np.ones(n, bool)
    close = unit @ unit.T >= least - 1e-12
    for i in np.flatnonzero(close.sum(1) > 1).tolist():
        if not free[i]:
            continue
        mine = np.flatnonzero(close[i] & free)
        for _ in range(2):  # the mean of all, then of those near it
            mean = unit[mine].mean(0)
            mean /= max(np.sqrt((mean * mean).sum()), 1e-300)
            mine = np.flatnonzero(free & (np.arccos(np.clip(unit @ mean, -1, 1)) + radius <= half))
            if not mine.size:
                break
        if mine.size < 2:
            mine = np.flatnonzero(close[i] & free)
            if not loose or mine.size < 2:
                continue
            pairs = linked(unit[mine], unit[mine], least)
            np.fill_diagonal(pairs, False)
            mine, pairs = (mine[keep := pairs[mine == i][0] | (mine == i)], pairs[np.ix_(keep, keep)])
            if mine.size < 2:
                continue
            tight[mine], inside[mine] = False, pairs @ weight[mine]
        else:
            inside[mine] = weight[mine].sum() - weight[mine]
        ball[mine], free[mine] = mine[0], False
    return ball, tight, inside


_ITEM = "item long, cell long, v binary, radius double, weight long"


def _balls(items: DataFrame, d: int, least: float, loose: bool) -> DataFrame:
    """(item, ball, tight, inside) of items (item, cell, group, v, radius, weight), by groups of whole cells or parts of one."""

    def form(key, table):
        order = np.argsort(table["cell"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        unit, radius, weight = _matrix(table["v"], d), table["radius"].to_numpy(), table["weight"].to_numpy().astype(float)
        ball, tight, inside = np.arange(len(unit)), np.ones(len(unit), bool), np.zeros(len(unit))
        for a, b in common.runs_of(table["cell"].to_numpy())[1]:
            if b - a > 1:
                ball[a:b], tight[a:b], inside[a:b] = gather(unit[a:b], radius[a:b], weight[a:b], least, loose)
                ball[a:b] += a
        return pa.table({"item": table["item"], "ball": table["item"].take(pa.array(ball)), "tight": pa.array(tight), "inside": pa.array(inside.astype(np.int64))})

    return items.groupBy("group", "part").applyInArrow(form, "item long, ball long, tight boolean, inside long")


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), float).reshape(-1, d)


def _dealt(items: DataFrame, part: int) -> tuple[DataFrame, int]:
    """`items` with `group` and `part`: cells of at most `part` items stay whole in groups of about as many, others are dealt in parts; the
    items of the largest cell."""
    sizes = items.groupBy("cell").agg(F.count("*").alias("_n"))
    total, largest = sizes.agg(F.sum("_n"), F.max("_n")).first()
    groups = common.parts_for(total or 0, part)
    crowded = sizes.where(F.col("_n") > part).withColumn("_parts", F.ceil(F.col("_n") / F.lit(part)).cast("long"))
    dealt = items.join(crowded.drop("_n"), "cell", "left")
    whole = F.col("_parts").isNull()
    return dealt.withColumn("group", F.when(whole, F.pmod("cell", F.lit(groups).cast("long"))).otherwise(F.col("cell"))).withColumn("part", F.when(whole, F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("item"), F.col("_parts")))).drop("_parts"), largest or 0


def balls(nodes: DataFrame, d: int, least: float = COSINE, part: int = PART) -> DataFrame:
    """(node, v, n, first, ball, tight, inside) of nodes (node, v, n, first, cell); written."""
    items = nodes.select(F.col("node").alias("item"), "cell", "v", F.lit(0.0).alias("radius"), F.col("n").alias("weight"))
    dealt, largest = _dealt(items, part)
    found = written(_balls(dealt, d, least, True).withColumnRenamed("item", "node"), "balls")
    told = written(nodes.drop("cell").join(found, "node"), "balls")
    while largest > part:  # tight balls of the parts of one cell may be one
        centres = centre(told.where("tight"), d)
        whole = centres.withColumn("cell", F.col("home")).withColumnRenamed("ball", "item")
        before = largest
        dealt, largest = _dealt(whole.select("item", "cell", "v", "radius", "weight"), part)
        if largest > before / 2:  # most stay apart: merging on would only save work
            break
        merged = written(_balls(dealt, d, least, False).where("item <> ball").select(F.col("item").alias("ball"), F.col("ball").alias("_into")), "balls")
        if merged.isEmpty():
            break
        told = written(told.join(merged, "ball", "left").withColumn("ball", F.coalesce("_into", "ball")).drop("_into"), "balls")
    return told


def centre(told: DataFrame, d: int) -> DataFrame:
    """(ball, v, radius, weight, size, first, home): mean direction of each ball, the angle of its farthest node, rows, nodes, least id.

    Sums of the nodes are taken in every task first, so a ball of any size is a few rows for the second pass.
    """
    alone = told.groupBy("ball").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("first").alias("first"), F.first("v").alias("v"))
    singles = alone.where("size = 1").withColumn("radius", F.lit(0.0))
    many = told.join(alone.where("size > 1").select("ball"), "ball", "left_semi")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, at = np.unique(batch.column("ball").to_numpy(), return_inverse=True)
                sums = np.zeros((names.size, d))
                np.add.at(sums, at, _matrix(batch.column("v"), d))
                yield pa.RecordBatch.from_pydict({"ball": pa.array(names), "s": vectors.list_column(sums)})

    sums = many.select("ball", "v").mapInArrow(add, "ball long, s array<double>")
    mean = sums.groupBy("ball").agg(*[F.sum(F.get("s", k)).alias(f"s{k}") for k in range(d)]).select("ball", F.array(*[f"s{k}" for k in range(d)]).alias("mean"))

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                mean = _units(np.array(batch.column("mean").flatten(), float).reshape(-1, d))
                angle = np.arccos(np.clip((_matrix(batch.column("v"), d) * mean).sum(1), -1, 1))
                names, first, at = np.unique(batch.column("ball").to_numpy(), return_index=True, return_inverse=True)
                far = np.zeros(names.size)
                np.maximum.at(far, at, angle)
                yield pa.RecordBatch.from_pydict({"ball": pa.array(names), "v": pa.array([m.tobytes() for m in mean[first]], pa.binary()), "radius": pa.array(far + SPARE)})

    far = many.select("ball", "v").join(mean, "ball").mapInArrow(widest, "ball long, v binary, radius double").groupBy("ball").agg(F.first("v").alias("v"), F.max("radius").alias("radius"))
    told = singles.unionByName(alone.drop("v").join(far, "ball"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _matrix(batch.column("v"), d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells(unit, 0, 0)[:, 0]), pa.array(signs(unit))], names=[*batch.schema.names, "home", "signs"])

    columns = told.select("ball", "size", "weight", "first", "v", "radius")
    return written(columns.mapInArrow(place, "ball long, size long, weight long, first long, v binary, radius double, home long, signs long"), "centres")


# --- candidates -------------------------------------------------------------------


def candidates(told: DataFrame, centres: DataFrame, d: int, least: float, tables: int, probes: int, part: int) -> DataFrame:
    """Distinct (a, b), a < b, of balls one of which is at home in a cell that the other is in or probes."""
    angle = math.acos(least) + SPARE
    rows = told.select("ball", "v").join(centres.select("ball", "radius", "signs"), "ball")

    def stand(probes: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                unit, ball = _matrix(batch.column("v"), d), batch.column("ball").to_numpy()
                for t in range(tables):
                    found = cells(unit, t, probes)
                    home = np.arange(found.shape[1]) == 0
                    every = np.rec.fromarrays([found.ravel(), np.repeat(ball, found.shape[1]), np.tile(~home, len(found))], names="cell,ball,visits")
                    order = np.lexsort((every.visits, every.ball, every.cell))
                    every = every[order]
                    fresh = np.append(True, (every.cell[1:] != every.cell[:-1]) | (every.ball[1:] != every.ball[:-1]))  # home first
                    at = np.repeat(np.arange(len(found)), found.shape[1])[order][fresh]
                    yield pa.RecordBatch.from_pydict({"cell": pa.array(every.cell[fresh]), "ball": pa.array(every.ball[fresh]), "home": pa.array(~every.visits[fresh]), "radius": batch.column("radius").take(pa.array(at)).cast(pa.float32()), "signs": batch.column("signs").take(pa.array(at))})

        return rows.mapInArrow(run, "cell long, ball long, home boolean, radius float, signs long")

    # balls at home in a cell, from which follows how many parts a crowded one needs
    size = stand(0).groupBy("cell").agg(F.count("*").alias("n"))
    crowded = size.where(F.col("n") > part // (probes + 1)).select("cell", F.ceil(F.col("n") * (probes + 1) / F.lit(part)).cast("int").alias("parts"))
    crowded = written(crowded, "crowded")
    few = crowded.limit(BROADCAST_ROWS + 1).count()  # mostly none: then the rows need no join, and few are broadcast
    groups = common.parts_for(told.count() * tables * (probes + 1), 4 * part)
    if few:
        dealt = stand(probes).join(F.broadcast(crowded) if few <= BROADCAST_ROWS else crowded, "cell", "left")
    else:
        dealt = stand(probes).withColumn("parts", F.lit(None).cast("int"))
    own = F.pmod(F.xxhash64("ball"), F.col("parts")).cast("int")
    # a pair of parts is one group, and so is a part with itself
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = dealt.withColumn("_p", F.explode(F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(pair)))
    whole = F.col("parts").isNull()
    dealt = dealt.select("cell", "ball", "home", "radius", "signs", F.when(whole, F.pmod("cell", F.lit(groups).cast("long"))).otherwise(F.col("cell")).alias("g"), "_p.i", "_p.j")

    def meet(key, table):
        cell, ball, home = table["cell"].to_numpy(), table["ball"].to_numpy(), table["home"].to_numpy()
        order = np.lexsort((~home, ball, cell))
        order = order[np.append(True, (cell[order][1:] != cell[order][:-1]) | (ball[order][1:] != ball[order][:-1]))] if order.size else order
        order = order[np.lexsort((~home[order], cell[order]))]  # those at home first
        cell, ball, home = cell[order], ball[order], home[order]
        radius, sign = table["radius"].to_numpy()[order].astype(float), table["signs"].to_numpy()[order].view(np.uint64)
        found = []
        for a, b in common.runs_of(cell)[1]:
            at_home = int(home[a:b].sum())
            for i in range(a, a + at_home):  # each with those after it: others at home, then visitors
                if i + 1 < b:
                    apart = np.bitwise_count(sign[i] ^ sign[i + 1 : b])
                    near = np.flatnonzero(apart <= signs_apart(angle + radius[i] + radius[i + 1 : b])) + i + 1
                    if near.size:
                        found.append(np.stack([np.minimum(ball[i], ball[near]), np.maximum(ball[i], ball[near])], 1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return dealt.groupBy("g", "i", "j").applyInArrow(meet, "a long, b long").distinct()


# --- links ---------------------------------------------------------------------------


def verdicts(pairs: DataFrame, centres: DataFrame, d: int, least: float) -> DataFrame:
    """Candidates (a, b, wa, wb) with `every`: true if all nodes of the two balls are linked, null if some may be; the others are left out."""
    side = lambda name: centres.select(F.col("ball").alias(name), F.col("v").alias(f"v{name}"), F.col("radius").alias(f"r{name}"), F.col("weight").alias(f"w{name}"), (F.col("size") == 1).alias(f"one{name}"))
    wanted = math.acos(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            va, vb = (_matrix(batch.column(c), d) for c in ("va", "vb"))
            s = (va * vb).sum(1)
            apart = np.arccos(np.clip(s, -1, 1))
            wide = np.array(batch.column("ra")) + np.array(batch.column("rb"))
            single = np.array(batch.column("onea")) & np.array(batch.column("oneb"))
            yes, maybe = apart + wide <= wanted - SPARE, apart - wide <= wanted + SPARE
            for i in np.flatnonzero(single & maybe):
                yes[i] = linked(va[i : i + 1], vb[i : i + 1], least)[0, 0]
            keep = np.flatnonzero(yes | (maybe & ~single))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in ("a", "b", "wa", "wb")), pa.array(yes[keep])], names=["a", "b", "wa", "wb", "every"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long, wa long, wb long, every boolean")


def compared(pairs: DataFrame, told: DataFrame, d: int, least: float, block: int = BLOCK) -> DataFrame:
    """(node, other ball, own ball, links) of nodes with links into another ball of `pairs` (a, b), block of nodes by block."""
    ends = pairs.select(F.col("a").alias("ball")).union(pairs.select(F.col("b").alias("ball"))).distinct()
    few = told.join(ends, "ball", "left_semi")
    sizes = few.groupBy("ball").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_b"))
    few = few.join(sizes, "ball").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("_b")).cast("int"))

    def pack(key, table):
        return pa.table({"ball": pa.array([key[0].as_py()]), "nodes": pa.array([table["node"].to_pylist()], pa.list_(pa.int64())), "n": pa.array([table["n"].to_pylist()], pa.list_(pa.int64())), "m": pa.array([b"".join(table["v"].to_pylist())], pa.binary())})

    packed = written(few.select("ball", "blk", "node", "n", "v").groupBy("ball", "blk").applyInArrow(pack, "ball long, nodes array<long>, n array<long>, m binary"), "blocks")
    side = lambda k: packed.select(F.col("ball").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("nodes", "n", "m")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                links = linked(np.frombuffer(row["m_a"]).reshape(-1, d), np.frombuffer(row["m_b"]).reshape(-1, d), least)
                for own, other, found in (("a", "b", links), ("b", "a", links.T)):
                    n = found @ np.array(row[f"n_{other}"], np.int64)
                    at = np.flatnonzero(n)
                    yield pa.RecordBatch.from_pydict({"node": pa.array(np.array(row[f"nodes_{own}"], np.int64)[at]), "own": pa.array([row[own]] * at.size, pa.int64()), "other": pa.array([row[other]] * at.size, pa.int64()), "links": pa.array(n[at])})

    return written(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "node long, own long, other long, links long"), "links")


def classes(df: DataFrame, least: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES, probes: int = PROBES, part: int = PART, bucket_part: int = BUCKET_PART, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row for every row."""
    common.small_batches(df.sparkSession)
    d = vectors.dimension(df, vec_col)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = vectors.matrix(batch.column("vec"), d)
            able = np.zeros(len(ok), bool)
            able[np.flatnonzero(ok)] = (x != 0).any(1)
            data = iter(v.tobytes() for v in x[(x != 0).any(1)] + 0.0)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "x": pa.array([next(data) if k else None for k in able.tolist()], pa.binary())})

    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).mapInArrow(pack, "vec_id long, x binary")
    rows = written(rows.withColumn("key", F.unhex(F.sha2("x", 256))), "vectors")
    distinct = rows.where("x is not null").groupBy("x", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(_matrix(batch.column("x"), d)) if batch.num_rows else np.empty((0, d))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "first")), pa.array([v.tobytes() for v in unit], pa.binary()), pa.array(cells(unit, 0, 0)[:, 0] if len(unit) else [], pa.int64())], names=["key", "n", "first", "v", "cell"])

    nodes = written(distinct.mapInArrow(place, "key binary, n long, first long, v binary, cell long").withColumn("node", F.monotonically_increasing_id()), "nodes")
    told = balls(nodes.select("node", "v", "n", "first", "cell"), d, least, part)
    centres = centre(told, d)
    pairs = written(verdicts(candidates(told, centres, d, least, tables, probes, bucket_part), centres, d, least), "pairs")
    whole = pairs.where("every")
    some = compared(pairs.where("not every"), told, d, least, block)
    by_ball = whole.select(F.col("a").alias("ball"), F.col("wb").alias("w")).union(whole.select(F.col("b").alias("ball"), F.col("wa").alias("w"))).groupBy("ball").agg(F.sum("w").alias("_w"))
    by_node = some.groupBy("node").agg(F.sum("links").alias("_l"))
    edges = whole.select("a", "b").union(some.where("own < other").select("own", "other").distinct())
    component = connected_components(edges, "a", "b")
    names = centres.select("ball", "first").join(component.withColumnRenamed("node", "ball"), "ball", "left").withColumn("component", F.coalesce("component", "ball"))
    names = names.join(names.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("ball", "component_id")
    own = F.when(F.col("tight"), F.col("weight") - F.col("n")).otherwise(F.col("inside"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    links = told.join(centres.select("ball", "weight"), "ball").join(by_ball, "ball", "left").join(by_node, "node", "left").join(names, "ball")
    links = links.select("node", (F.col("n") - 1 + own + zero("_w") + zero("_l")).alias("n_links"), "component_id").join(nodes.select("node", "key"), "node")
    out = rows.select("vec_id", "key").join(links, "key", "left")
    return out.select("vec_id", zero("n_links").alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
