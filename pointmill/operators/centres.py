"""Cluster centres by draws, by batches and by modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointmill.functions.geometry import XYZ, sq_distance
from pointmill.functions.tables import written
from pointmill.operators import cluster, spatial

Point = tuple[float, ...]


def uniform(*values: Column) -> Column:
    """A number over 0 and up to 1 from the md5 of the values as text, joined by colons."""
    text = F.concat_ws(":", *[v.cast("string") for v in values])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def draw_key(d: Column, mean: Column, u: Column) -> Column:
    """The row with the least key is drawn in proportion to exp(d) among those with d at or above the mean; null for the others.

    -ln(u) / exp(d) is exponential with rate exp(d); its logarithm neither overflows nor ties.
    """
    return F.when(d >= mean, F.log(-F.log(u)) - d)


def seed_drawn(df: DataFrame, k: int, seed: int = 0, cols: Sequence[str] = XYZ, id: str = "pid") -> list[Point]:
    """k rows as centres: the first drawn evenly, each next in proportion to exp(distance to the nearest so far), where that is not
    below the mean distance.

    Draws depend on the md5 of (seed, step, id), so they don't depend on the order of rows; two aggregates for each centre. Rows with
    a null coordinate aren't drawn; with fewer than k rows, centres repeat; an empty table gives none.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(F.col(id).alias("_id"), *[F.col(c).cast("double").alias(c) for c in cols])
    u = lambda step: uniform(F.lit(seed), F.lit(step), F.col("_id"))
    place = F.struct(*cols)
    first = rows.agg(F.min_by(place, F.struct(u(0).alias("u"), "_id")).alias("p")).first()["p"]
    if first is None:
        return []
    found = [tuple(first)]
    for step in range(1, k):
        d = [sq_distance([F.col(c) for c in cols], [F.lit(v) for v in p]) for p in found]
        far = rows.withColumn("_d", F.sqrt(F.least(*d) if len(d) > 1 else d[0]))
        mean = far.agg(F.avg("_d")).first()[0]
        # an average can be rounded above all of equal distances
        key = draw_key(F.col("_d"), F.lit(mean * (1 - 1e-12)), u(step))
        found.append(tuple(far.agg(F.min_by(place, F.when(key.isNotNull(), F.struct(key.alias("k"), "_id"))).alias("p")).first()["p"]))
    return found


def minibatch_kmeans(df: DataFrame, start: Sequence[Point], batches: int, passes: int = 10, tol: float = 1e-4, cols: Sequence[str] = XYZ, id: str = "pid") -> tuple[DataFrame, list[Point]]:
    """(pid, k) and the centres after passes over batches: a centre moves to the mean of all rows it was given so far.

    Batch of a row: crc32 of its id as text, modulo `batches`. Rows are written once by batch, so a step reads its batch alone.
    Stops when a whole pass moved no centre by more than `tol`; raises after `passes` passes unless tol is None, which takes what
    they give. A centre that was never nearest stays. Rows with a null coordinate are given no centre.
    """
    able = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(id, *[F.col(c).cast("double").alias(c) for c in cols])
    dealt = written(able.withColumn("_batch", (F.crc32(F.col(id).cast("string").cast("binary")) % F.lit(batches)).cast("int")).repartition("_batch"), "batches", by=("_batch",))
    centres, counts = [tuple(map(float, p)) for p in start], [0] * len(start)
    for _ in range(passes):
        before = centres
        for b in range(batches):
            told = cluster.with_nearest(dealt.where(F.col("_batch") == b), centres, cols).groupBy("k").agg(F.count("*").alias("_n"), *[F.sum(c).alias(c) for c in cols])
            for r in told.collect():  # a row a centre
                k, old = r["k"], counts[r["k"]]
                counts[k] += r["_n"]
                centres = [tuple((v * old + r[c]) / counts[k] for v, c in zip(p, cols, strict=True)) if i == k else p for i, p in enumerate(centres)]
        if tol is not None and max(abs(a - b) for p, q in zip(centres, before, strict=True) for a, b in zip(p, q, strict=True)) <= tol:
            break
    else:
        if tol is not None:
            raise RuntimeError(f"centres still move after {passes} passes")
    return cluster.with_nearest(able, centres, cols).select(id, "k"), centres


def estimate_bandwidth(df: DataFrame, quantile: float = 0.3, sample: int = 2000, cols: Sequence[str] = XYZ, id: str = "pid") -> float:
    """Mean distance of a row to its neighbour number int(quantile * rows), itself the first; rows are a bounded sample.

    `sample` rows in the order of a hash of the id (all, if the table has no more), and neighbours among them: a share of all rows is
    a number of pairs that grows with the square. 0 for an empty table.
    """
    some = written(df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(id, *cols).orderBy(F.xxhash64(id), id).limit(sample), "sample")
    k = max(1, int(quantile * some.count()))
    found = spatial.knn_brute(some, some, k, qid=id, bid=id, cols=cols)
    return float(found.groupBy("qid").agg(F.max("dist").alias("d")).agg(F.avg("d")).first()[0] or 0.0)


def bin_seeds(df: DataFrame, size: float, least: int = 1, cols: Sequence[str] = XYZ) -> DataFrame:
    """(seed, cols..): the centres of grid bins with at least `least` rows; a coordinate half way goes to the even bin."""
    bins = df.select(*[F.rint(F.col(c) / size).alias(c) for c in cols]).groupBy(*cols).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return bins.select(F.monotonically_increasing_id().alias("seed"), *[(F.col(c) * size).alias(c) for c in cols])


def mean_shift_seeded(df: DataFrame, bandwidth: float, least: int = 1, max_iter: int = 300, cols: Sequence[str] = XYZ, id: str = "pid") -> tuple[DataFrame, DataFrame]:
    """Mean shift from binned seeds: (pid, cluster) and the modes (cluster, cols.., n).

    A seed moves to the mean of the rows within the bandwidth until it moves by no more than a thousandth of it; n is the number of
    rows around it then. Of modes within the bandwidth of each other the one with the most rows (then the greatest coordinates) stays;
    rows go to the nearest mode. Clusters are numbered by falling n, then falling coordinates. Raises if seeds still move after
    `max_iter` rounds. Seeds are bins, so copies of a row cost nothing more; at most three dimensions.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in cols)).select(F.col(id).alias("nid"), *[F.col(c).cast("double").alias(c) for c in cols])
    now, done, tol = written(bin_seeds(rows, bandwidth, least, cols), "seeds"), None, 1e-3 * bandwidth
    for _ in range(max_iter):
        near = spatial.radius_join(now, rows, bandwidth, qid="seed", bid="nid", cols=cols).join(rows, "nid")
        mean = near.groupBy(F.col("qid").alias("seed")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in cols])
        old = now.select("seed", *[F.col(c).alias(f"_{c}") for c in cols])
        step = sq_distance([F.col(c) for c in cols], [F.col(f"_{c}") for c in cols])
        new = written(mean.join(old, "seed").select("seed", "n", *cols, (step > tol * tol).alias("_moves")), "seeds")
        still = new.where("not _moves").drop("_moves", "seed")
        done = still if done is None else done.unionByName(still)
        now = new.where("_moves").drop("_moves", "n")
        if now.isEmpty():
            break
    else:
        raise RuntimeError(f"seeds still move after {max_iter} rounds")
    best = written(done.groupBy(*cols).agg(F.max("n").alias("n")).withColumn("seed", F.monotonically_increasing_id()), "modes")
    modes = _first_in_reach(best, bandwidth, cols)
    named = spatial.ranked(modes, [F.desc("n"), *[F.desc(c) for c in cols]], name="k").select((F.col("k") - 1).alias("k"), *cols, "n")
    named = written(named, "modes")
    return cluster.assign(rows.withColumnRenamed("nid", id), named, cols, id).select(id, F.col("k").alias("cluster")), named.withColumnRenamed("k", "cluster")


def _first_in_reach(best: DataFrame, reach: float, cols: Sequence[str]) -> DataFrame:
    """The rows (seed, cols.., n) that stay if, by falling n and coordinates, each kept one drops the others in reach.

    Rounds: a row that comes before all undecided ones in its reach stays, and those in its reach go.
    """
    order = F.struct("n", *cols)
    rank = best.select(F.col("seed").alias("nid"), order.alias("_other"))
    pairs = written(spatial.radius_join(best, best, reach, qid="seed", bid="seed", cols=cols).where("qid <> nid").join(rank, "nid").join(best.select(F.col("seed").alias("qid"), order.alias("_own")), "qid").select("qid", "nid", (F.col("_other") > F.col("_own")).alias("after")), "reach")
    open_, kept = best.select("seed"), None
    while True:
        live = pairs.join(open_.withColumnRenamed("seed", "qid"), "qid", "left_semi").join(open_.withColumnRenamed("seed", "nid"), "nid", "left_semi")
        first = written(open_.join(live.where("after").select(F.col("qid").alias("seed")).distinct(), "seed", "left_anti"), "first")
        kept = first if kept is None else kept.unionByName(first)
        gone = first.unionByName(pairs.join(first.withColumnRenamed("seed", "qid"), "qid", "left_semi").select(F.col("nid").alias("seed"))).distinct()
        open_ = written(open_.join(gone, "seed", "left_anti"), "open")
        if open_.isEmpty():
            return best.join(kept, "seed", "left_semi")
