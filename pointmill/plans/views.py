"""Stand-in relations over the generated tables: points, vectors and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, frame, x, y, z): a small cloud in ten frames."""
    at = lambda i: (F.element_at("embedding", i).cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("int").alias("frame"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


def pts_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k1..k5, frame, x, y, z): a large cloud in eight frames."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("l_partkey").alias("k3"), F.col("l_suppkey").alias("k4"), F.col("l_extendedprice").alias("k5"),
        (F.col("l_orderkey") % 8).alias("frame"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice").cast("double") / 1000).alias("y"), (F.col("l_discount").cast("double") * 100).alias("z"),
    )


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, frame, x, y, z): a cloud with the extent of a vehicle's scan; most z lie on a slope near -1.7."""
    p = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(
        p.alias("pid"), (p % 4).cast("int").alias("frame"), (((p * 7919) % 12007).cast("double") / 100 - 60).alias("x"), (((p * 104729) % 5003).cast("double") / 100 - 20).alias("y"),
        (F.when(p % 5 == 0, ((p * 31) % 211).cast("double") / 100 - 1.5).otherwise(F.lit(-1.7) + ((p * 17) % 11).cast("double") / 200) + ((p * 7919) % 12007).cast("double") / 1000000).alias("z"),
    )


def vec64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, label, vec)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").cast("int").alias("label"), F.col("embedding").alias("vec"))


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    kind = F.when(p % 10 < 5, "Car").when(p % 10 < 7, "Pedestrian").when(p % 10 == 7, "Cyclist").when(p % 10 == 8, "Van").otherwise("DontCare")
    d = lambda c: c.cast("double")
    size = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select(
        (p % 49).cast("int").alias("frame"), p.alias("ord"), kind.alias("type"), (d((p * 7) % 11) / 20).alias("truncation"), ((p * 3) % 4).cast("int").alias("occlusion"), (d((p * 13) % 628) / 100 - 3.14).alias("alpha"),
        d((p * 37) % 1000).alias("x1"), d((p * 53) % 250).alias("y1"), d((p * 37) % 1000 + 20 + 3 * size).alias("x2"), d((p * 53) % 250 + 20 + 2 * size).alias("y2"),
    )


def det_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gt_boxes(spark, sf_dir).where("type <> 'DontCare' and ord % 7 <> 0")
    o = F.col("ord")
    moved = g.select(
        "frame", "ord", "type", "alpha", (F.col("x1") + (o * 11) % 7 - 3).alias("x1"), (F.col("y1") + (o * 5) % 7 - 3).alias("y1"),
        (F.col("x2") + (o * 11) % 7 - 3).alias("x2"), (F.col("y2") + (o * 5) % 7 - 3).alias("y2"), (((o * 7919) % 10007).cast("double") / 10007).alias("score"),
    )
    s = F.col("s_suppkey").cast("long")
    d = lambda c: c.cast("double")
    false = table(spark, sf_dir, "supplier").select(
        (s % 49).cast("int").alias("frame"), (1000000 + s).alias("ord"), F.lit("Car").alias("type"), F.lit(0.0).alias("alpha"), d((s * 41) % 1000).alias("x1"), d((s * 59) % 250).alias("y1"),
        d((s * 41) % 1000 + 60).alias("x2"), d((s * 59) % 250 + 50).alias("y2"), (d((s * 7919) % 10007) / 10007).alias("score"),
    )
    return moved.unionByName(false)


def with_3d(boxes: DataFrame, shifted: bool = False) -> DataFrame:
    """Adds h, w, l, t1, t2, t3, ry."""
    o = F.col("ord")
    shift = ((o * 11) % 7 - 3).cast("double") / 10.0 if shifted else F.lit(0.0)
    return boxes.select("*", F.lit(1.5).alias("h"), F.lit(1.6).alias("w"), F.lit(3.9).alias("l"), (((o * 17) % 80 - 40).cast("double") + shift).alias("t1"), F.lit(1.7).alias("t2"), (((o * 29) % 70).cast("double") + shift).alias("t3"), F.col("alpha").alias("ry"))


#: The same relations for DuckDB.
VIEWS_SQL = """
pts3 as (
  select vec_id as pid, cast(label as int) as frame, cast(embedding[1] as double) * 10 as x, cast(embedding[2] as double) * 10 as y, cast(embedding[3] as double) * 10 as z from embeddings
), pts_big as (
  select l_orderkey as k1, l_linenumber as k2, l_partkey as k3, l_suppkey as k4, l_extendedprice as k5, l_orderkey % 8 as frame,
    cast(l_quantity as double) as x, cast(l_extendedprice as double) / 1000 as y, cast(l_discount as double) * 100 as z from lineitem
), scan as (
  select p_partkey::bigint as pid, cast(p_partkey % 4 as int) as frame, ((p_partkey::bigint * 7919) % 12007)::double / 100 - 60 as x, ((p_partkey::bigint * 104729) % 5003)::double / 100 - 20 as y,
    case when p_partkey % 5 = 0 then ((p_partkey::bigint * 31) % 211)::double / 100 - 1.5::double else -1.7::double + ((p_partkey::bigint * 17) % 11)::double / 200 end + ((p_partkey::bigint * 7919) % 12007)::double / 1000000 as z from part
), vec64 as (
  select vec_id as pid, cast(label as int) as label, embedding as vec from embeddings
), gt_boxes as (
  select cast(p_partkey % 49 as int) as frame, p_partkey::bigint as ord,
    case when p_partkey % 10 < 5 then 'Car' when p_partkey % 10 < 7 then 'Pedestrian' when p_partkey % 10 = 7 then 'Cyclist' when p_partkey % 10 = 8 then 'Van' else 'DontCare' end as type,
    cast((p_partkey * 7) % 11 as double) / 20 as truncation, cast((p_partkey * 3) % 4 as int) as occlusion, cast((p_partkey * 13) % 628 as double) / 100 - 3.14::double as alpha,
    cast((p_partkey * 37) % 1000 as double) as x1, cast((p_partkey * 53) % 250 as double) as y1,
    cast((p_partkey * 37) % 1000 + 20 + 3 * p_size as double) as x2, cast((p_partkey * 53) % 250 + 20 + 2 * p_size as double) as y2 from part
), det_boxes as (
  select frame, ord, type, alpha, x1 + (ord * 11) % 7 - 3 as x1, y1 + (ord * 5) % 7 - 3 as y1, x2 + (ord * 11) % 7 - 3 as x2, y2 + (ord * 5) % 7 - 3 as y2,
    cast((ord * 7919) % 10007 as double) / 10007 as score from gt_boxes where type <> 'DontCare' and ord % 7 <> 0
  union all
  select cast(s_suppkey % 49 as int), 1000000 + s_suppkey, 'Car', 0::double, cast((s_suppkey * 41) % 1000 as double), cast((s_suppkey * 59) % 250 as double),
    cast((s_suppkey * 41) % 1000 + 60 as double), cast((s_suppkey * 59) % 250 + 50 as double), cast((s_suppkey * 7919) % 10007 as double) / 10007 from supplier
), gt3 as (
  select *, 1.5::double as h, 1.6::double as w, 3.9::double as l, ((ord * 17) % 80 - 40)::double as t1, 1.7::double as t2, ((ord * 29) % 70)::double as t3, alpha as ry from gt_boxes
), det3 as (
  select *, 1.5::double as h, 1.6::double as w, 3.9::double as l, ((ord * 17) % 80 - 40)::double + ((ord * 11) % 7 - 3)::double / 10 as t1, 1.7::double as t2,
    ((ord * 29) % 70)::double + ((ord * 11) % 7 - 3)::double / 10 as t3, alpha as ry from det_boxes
)"""


def with_views(sql: str) -> str:
    """The SQL after the views' definitions; it may go on with its own WITH."""
    sql = sql.strip()
    lower = sql[:15].lower()
    if lower.startswith("with recursive "):
        return f"with recursive {VIEWS_SQL.strip()}, {sql[15:]}"
    return f"with {VIEWS_SQL.strip()}" + (f", {sql[5:]}" if lower.startswith("with ") else f"\n{sql}")
