"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointmill.functions.tables import written

#: Edges that a task contracts at a time.
CONTRACT_ROWS = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node that each is connected to by them."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: a.size], flat[a.size :]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def out() -> pa.RecordBatch:
        nodes, low = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        keep = nodes != low
        return pa.RecordBatch.from_pydict({"u": pa.array(low[keep]), "v": pa.array(nodes[keep])})

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(zero_copy_only=False), batch.column("v").to_numpy(zero_copy_only=False)))
        if sum(h[0].size for h in held) >= CONTRACT_ROWS:
            yield out()
            held = []
    if held:
        yield out()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge with another node; the component is its least node.

    Edges are undirected BIGINT pairs. Tasks first contract the edges they hold to forests; then large-star
    and small-star rounds alternate until the edges no longer change. Rounds are cut by written tables.
    """
    pairs = edges.where(F.col(src) != F.col(dst)).select(F.least(src, dst).cast("long").alias("u"), F.greatest(src, dst).cast("long").alias("v"))
    now = written(pairs.mapInArrow(_contract, "u long, v long").distinct(), "edges")

    def tally(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    last = tally(now)
    for _ in range(max_rounds):
        if last[0] == 0:
            break
        # large star: every node hands its larger neighbours to its least neighbour (or itself)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = now.join(least, now["u"] == least["k"]).select(F.col("m").alias("u"), "v").where("u < v").distinct()
        # small star: every node hands its smaller neighbours and itself to the least of them
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("k"), "m")
        small = large.join(low, large["v"] == low["k"]).select("m", "u", "v")
        now = written(small.select(F.col("m").alias("u"), F.col("u").alias("v")).unionByName(small.select(F.col("m").alias("u"), "v")).where("u < v").distinct(), "edges")
        new = tally(now)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
