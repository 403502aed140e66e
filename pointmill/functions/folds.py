"""Work on groups of rows that meet in one task: some sides are held, the last one streams by."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a matrix that a task works on at a time.
CELLS = 1 << 20


def _columns(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    out = []
    for k in range(n):
        c = batch.column(f"_c{k}")
        if pa.types.is_list(c.type):
            out.append(np.asarray(c.flatten()).reshape(len(c), -1))
        else:
            out.append(c.to_numpy(zero_copy_only=False))
    return out


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def folded(sides: Sequence[tuple[DataFrame, Sequence[str | Column]]], group: Sequence[str], fold: Callable, schema: str, order: Sequence[int] = (), tasks: int | None = None) -> DataFrame:
    """(group.., schema): what `fold` makes of the rows of each group.

    Every side is a frame with the columns `group` and the columns given with it, which have the same types at the same place on
    all sides. All sides but the last are held by the task, a group at a time: `fold(key, *held)` gets their columns as arrays and
    returns an object whose `add(columns)` gets the last side's rows, some at a time, and whose `end()` closes the group; both give
    dicts of columns of `schema`. The last side's rows come in the order of its columns at the places `order`. Rows with a null in
    `group` take no part. So a task has in memory what is held of one group, and of the last side no more than a batch.
    """
    spark = sides[0][0].sparkSession
    widest = max((df.select(*cols) for df, cols in sides), key=lambda d: len(d.columns))
    kinds = [f.dataType for f in widest.schema.fields]
    rows = None
    for k, (df, cols) in enumerate(sides):
        pad = [F.lit(None).cast(t) for t in kinds[len(cols) :]]
        named = [(F.col(c) if isinstance(c, str) else c).cast(t).alias(f"_c{i}") for i, (c, t) in enumerate(zip(cols, kinds, strict=False))] + [c.alias(f"_c{len(cols) + i}") for i, c in enumerate(pad)]
        one = df.dropna(subset=list(group)).select(*group, F.lit(k).cast("byte").alias("_side"), *named)
        rows = one if rows is None else rows.unionByName(one)
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    last, sizes, names = len(sides) - 1, [len(cols) for _, cols in sides], list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, None

        def told(found: Iterator[dict] | None) -> Iterator[pa.RecordBatch]:
            for columns in found or ():
                size = len(next(iter(columns.values())))
                if size:
                    yield pa.RecordBatch.from_pydict({**{c: pa.repeat(key_of[c], size) for c in names}, **{c: v if isinstance(v, pa.Array) else pa.array(v) for c, v in columns.items()}})

        def begun():
            return fold(key, *[[np.concatenate(c) for c in zip(*h, strict=True)] if h else None for h in held])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [_codes(batch.column(c)) for c in names] + [batch.column("_side").to_numpy(zero_copy_only=False)]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in codes:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(batch.column(c)[a].as_py() for c in names)
                if key is None or now != key:
                    if held is not None:
                        state = state or begun()
                        yield from told(state.end())
                    key, state, held = now, None, [[] for _ in range(last)]
                    key_of = {c: batch.column(c)[a] for c in names}
                side, part = int(codes[-1][a]), batch.slice(a, b - a)
                if side < last:
                    held[side].append(_columns(part, sizes[side]))
                else:
                    state = state or begun()
                    yield from told(state.add(_columns(part, sizes[last])))
        if held is not None:
            state = state or begun()
            yield from told(state.end())

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    put = ", ".join(f"`{c}` {types[c]}" for c in names)
    sort = [*names, "_side", *[f"_c{i}" for i in order]]
    return rows.repartition(n, *names).sortWithinPartitions(*sort).mapInArrow(run, f"{put}, {schema}" if put else schema)


def parts(df: DataFrame, id: str, size: int, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The frame with `_part`, a share of each key of about `size` rows, and (key.., _parts): how many there are.

    A small table has more and smaller shares, so that every core has some.
    """
    spread = 4 * df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(*key).agg(F.count("*").alias("_n")) if key else df.agg(F.count("*").alias("_n"))
    groups, total = (counts.agg(F.count("*"), F.sum("_n")).first())
    size = max(1, min(size, -(-int(total or 0) // spread))) if total else size
    # no more shares than cores need, or than the size asks for
    counts = counts.select(*key, F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(size))).cast("int").alias("_parts"))
    dealt = df.join(counts, list(key)) if key else df.join(F.broadcast(counts), F.lit(True))
    return dealt.withColumn("_part", F.pmod(F.xxhash64(id), F.col("_parts").cast("long")).cast("int")).drop("_parts"), counts


def for_parts(df: DataFrame, counts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """Every row of the other side once for each share of its key."""
    joined = df.join(counts, list(key)) if key else df.join(F.broadcast(counts), F.lit(True))
    return joined.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
