"""Voxel tables derived from the star-schema tables, in integer arithmetic.

A line item is a point: its volume is the return flag, z comes from the supplier, y from the part, x from the order.
The number of slices grows with the suppliers. `voxels` is the full grid with values 0..254: block-shaped regions
(sums over 2 x 4 x 4 blocks) plus noise (sums at a voxel).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = ["volume_id", "z", "y", "x"]
#: Suppliers a slice, and the height and width of a slice.
PER_SLICE, H, W = 4, 32, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str, h: int = H, w: int = W) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("volume_id"),
        F.expr(f"cast(l_suppkey div {PER_SLICE} as int)").alias("z"),
        (F.col("l_partkey") % h).cast("int").alias("y"),
        (F.col("l_orderkey") % w).cast("int").alias("x"),
        F.col("l_quantity").cast("long").alias("q"),
    )


def dims(spark: SparkSession, sf_dir: str, h: int = H, w: int = W) -> DataFrame:
    """(volume_id, d, h, w): every volume is as deep as the deepest."""
    each = points(spark, sf_dir, h, w).groupBy("volume_id").agg(F.max("z").alias("z"))
    deep = each.agg((F.max("z") + 1).cast("int").alias("d"))
    return each.select("volume_id").join(F.broadcast(deep), how="left").select("volume_id", "d", F.lit(h).alias("h"), F.lit(w).alias("w"))


def grid(sizes: DataFrame) -> DataFrame:
    """All voxels of (volume_id, d, h, w)."""
    axis = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    slices = sizes.withColumn("z", axis("d")).repartition("volume_id", "z")  # else the task that has a volume's row makes all
    return slices.withColumn("y", axis("h")).withColumn("x", axis("w")).select(*C)


#: Depth, height and width of the blocks whose sums voxels share.
BLOCK = (2, 4, 4)


def voxels(spark: SparkSession, sf_dir: str, h: int = H, w: int = W, sizes: DataFrame | None = None) -> DataFrame:
    """(C, value) of the full grid; sizes: dims, if they are stored already.

    Points meet once, by block, beside an empty row for every block of the grid; a block's sums are one row, which its
    voxels leave from. So no voxel is exchanged, and blocks are made where they are dealt to.
    """
    sizes = dims(spark, sf_dir, h, w) if sizes is None else sizes
    kd, kh, kw = BLOCK
    key = ["volume_id", "bz", "by", "bx"]
    at = [F.expr(f"{a} div {k}") for a, k in zip("zyx", BLOCK)]
    offset = [F.col(a) - b * k for a, b, k in zip("zyx", at, BLOCK)]
    place = F.when(F.col("z") >= 0, F.when(F.col("y") >= 0, F.when(F.col("x") >= 0, (offset[0] * kh + offset[1]) * kw + offset[2])))
    pts = points(spark, sf_dir, h, w).where("volume_id is not null")
    pts = pts.select("volume_id", *[b.cast("int").alias(n) for b, n in zip(at, key[1:])], place.cast("int").alias("place"), "q").where("bz >= 0 and by >= 0 and bx >= 0")
    axis = lambda n, k: F.explode(F.sequence(F.lit(0), F.expr(f"cast(({n} - 1) div {k} as int)")))
    empty = sizes.withColumn("bz", axis("d", kd)).withColumn("by", axis("h", kh)).withColumn("bx", axis("w", kw))
    empty = empty.select(*key, F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("q"))
    n = kd * kh * kw
    sums = pts.union(empty).repartition(*key).groupBy(*key).agg(F.sum("q").alias("all"), *[F.sum(F.when(F.col("place") == k, F.col("q"))).alias(f"s{k}") for k in range(n)])
    cells = sums.select(*key, F.coalesce(F.col("all") % 200, F.lit(0)).alias("coarse"), F.posexplode(F.array(*[F.coalesce(F.col(f"s{k}") % 56, F.lit(0)) for k in range(n)])).alias("k", "fine"))
    back = [F.col("bz") * kd + F.expr(f"k div {kh * kw}"), F.col("by") * kh + F.expr(f"k div {kw}") % kh, F.col("bx") * kw + F.col("k") % kw]
    both = cells.select("volume_id", *[b.cast("int").alias(a) for a, b in zip("zyx", back)], (F.col("coarse") + F.col("fine")).cast("double").alias("value"))
    deep = sizes.agg(F.max("d").alias("d"))
    return both.join(F.broadcast(deep), F.col("z") < F.col("d")).where((F.col("y") < h) & (F.col("x") < w)).select(*C, "value")


def mask_above(vox: DataFrame, t: float) -> DataFrame:
    return vox.where(F.col("value") > t).select(*C)


def run_noise(run: int | Column) -> Column:
    """Integer noise 0..10 of a prediction run."""
    return (F.col("z") * 31 + F.col("y") * 17 + F.col("x") * 13 + run) % 11


def prediction(vox: DataFrame, run: int = 0) -> DataFrame:
    """(C, area, edge): a run's two maps in [0, 1]."""
    return vox.select(*C, ((F.col("value") + 7 * run_noise(run)) / 330.0).alias("area"), ((F.col("value") + 5 * run_noise(run + 3)) / 330.0).alias("edge"))


def predictions(vox: DataFrame, runs: int = 3) -> DataFrame:
    """(run, C, area) of several runs."""
    return vox.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select("run", *C, ((F.col("value") + 7 * run_noise(F.col("run"))) / 330.0).alias("area"))


_AXES = "zs AS (SELECT CAST(unnest(range(0, (SELECT max(z) + 1 FROM points))) AS INTEGER) AS z), ys AS (SELECT CAST(unnest(range(0, {h})) AS INTEGER) AS y), xs AS (SELECT CAST(unnest(range(0, {w})) AS INTEGER) AS x)"


def sql(h: int = H, w: int = W) -> str:
    """The same tables as common table expressions: points, dims, voxels, gt (value > 128), seed (value >= 160)."""
    return f"""points AS MATERIALIZED (SELECT l_returnflag AS volume_id, CAST(l_suppkey // {PER_SLICE} AS INTEGER) AS z, CAST(l_partkey % {h} AS INTEGER) AS y, CAST(l_orderkey % {w} AS INTEGER) AS x, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
{_AXES.format(h=h, w=w)},
vols AS (SELECT DISTINCT volume_id FROM points),
dims AS MATERIALIZED (SELECT volume_id, (SELECT CAST(max(z) + 1 AS INTEGER) FROM points) AS d, {h} AS h, {w} AS w FROM vols),
fine AS (SELECT volume_id, z, y, x, sum(q) % 56 AS f FROM points GROUP BY ALL),
coarse AS (SELECT volume_id, z // 2 AS bz, y // 4 AS b_y, x // 4 AS bx, sum(q) % 200 AS c FROM points GROUP BY ALL),
voxels AS MATERIALIZED (SELECT g.volume_id, g.z, g.y, g.x, CAST(coalesce(c.c, 0) + coalesce(f.f, 0) AS DOUBLE) AS value FROM (SELECT * FROM vols, zs, ys, xs) g LEFT JOIN fine f ON f.volume_id = g.volume_id AND f.z = g.z AND f.y = g.y AND f.x = g.x LEFT JOIN coarse c ON c.volume_id = g.volume_id AND c.bz = g.z // 2 AND c.b_y = g.y // 4 AND c.bx = g.x // 4),
gt AS (SELECT volume_id, z, y, x FROM voxels WHERE value > 128),
seed AS (SELECT volume_id, z, y, x FROM voxels WHERE value >= 160)"""
