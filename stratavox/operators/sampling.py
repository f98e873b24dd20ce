"""Patch sampling and extraction, and seeded removal of annotation.

Random choices are seeded integer hashes, so that any engine and any partitioning gives the same picks. Global order
indices come from counts of slices first and a rank within a slice, never from one sorted partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import C
from ..sources.store import written
from .components import label_by_bins
from .morphology import dilate
from .pixel import value_bins


def seeded(key: Column, seed: int) -> Column:
    """A 32-bit hash of an integer in plain arithmetic."""
    return (F.pmod(key.cast("long"), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed * 40503)) % F.lit(4294967296)


def order_index(rows: DataFrame) -> DataFrame:
    """rows (C) with i, their row-major position in the volume, and n, the volume's number of rows."""
    slices = rows.groupBy("volume_id", "z").agg(F.count("*").alias("m"))
    w = Window.partitionBy("volume_id")
    before = w.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("volume_id", "z", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"), F.sum("m").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy("volume_id", "z").orderBy("y", "x")) - 1
    return rows.withColumn("r", inside).join(slices, ["volume_id", "z"]).select(*C, (F.col("before") + F.col("r")).cast("long").alias("i"), "n")


def sample_patches(mask: DataFrame, soft: DataFrame, dims: DataFrame, num: int, ph: int, pw: int, t: int = 2, threshold: float = 1.0, seed: int = 0) -> DataFrame:
    """(volume_id, k, z, y0, x0): num patch origins a volume, at even strides over the valid centres.

    Centres are the mask's voxels in row-major order, then max(1, int(0.01 * threshold * n)) of the soft negatives by a
    seeded hash; valid ones leave room for t slices and half a patch. Origins are clamped into the slice.
    """
    sizes = dims
    n = mask.groupBy("volume_id").agg(F.greatest(F.lit(1), F.floor(0.01 * threshold * F.count("*"))).alias("extra"))
    ranked = soft.join(sizes, "volume_id").select(*C, seeded((F.col("z") * F.col("h") + F.col("y")) * F.col("w") + F.col("x"), seed).alias("hash"))
    place = F.row_number().over(Window.partitionBy("volume_id").orderBy("hash", "z", "y", "x"))
    # the extras of a volume are among the smallest hashes of its slices
    local = F.row_number().over(Window.partitionBy("volume_id", "z").orderBy("hash", "y", "x"))
    few = ranked.withColumn("l", local).join(n, "volume_id").where(F.col("l") <= F.col("extra"))
    extras = few.withColumn("k", place).where(F.col("k") <= F.col("extra")).select(*C, "k")
    room = lambda df: df.join(sizes, "volume_id").where(
        (F.col("z") >= t) & (F.col("z") <= F.col("d") - t - 1) & (F.col("y") >= ph // 2) & (F.col("y") <= F.col("h") - ph // 2 - 1) & (F.col("x") >= pw // 2) & (F.col("x") <= F.col("w") - pw // 2 - 1)
    )
    extras = written(extras, "extras")
    main = written(order_index(written(room(mask.select(*C)).select(*C), "centres")), "main")
    count = main.groupBy("volume_id").agg(F.count("*").alias("main"))
    tail = room(extras).withColumn("j", F.row_number().over(Window.partitionBy("volume_id").orderBy("k")) - 1)
    tail = tail.join(count, "volume_id", "left").select(*C, (F.coalesce("main", F.lit(0)) + F.col("j")).cast("long").alias("i"))
    valid = main.select(*C, "i").unionByName(tail)
    total = valid.groupBy("volume_id").agg(F.count("*").alias("n"))
    picks = total.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(num - 1)))).select("volume_id", "k", F.expr("cast(k * n div %d as bigint)" % num).alias("i"))
    out = picks.join(valid, ["volume_id", "i"]).join(sizes, "volume_id")
    clamp = lambda c, half, size, n: F.greatest(F.lit(0), F.least(F.col(n) - size, F.col(c) - half)).cast("int")
    return out.select("volume_id", "k", "z", clamp("y", ph // 2, ph, "h").alias("y0"), clamp("x", pw // 2, pw, "w").alias("x0"))


def extract_patches(patches: DataFrame, voxels: DataFrame, ph: int, pw: int, t: int = 0, tile: int = 16) -> DataFrame:
    """(patch_id, dz, py, px, value): the voxels of each patch (patch_id, volume_id, z, y0, x0) and t slices around.

    The range join is an equi-join on tiles: a patch is listed at the tiles and slices it covers.
    """
    tiles = lambda c, n: F.sequence(F.expr(f"cast({c} div {tile} as int)"), F.expr(f"cast(({c} + {n - 1}) div {tile} as int)"))
    p = patches.withColumn("dz", F.explode(F.sequence(F.lit(-t), F.lit(t)))).withColumn("ty", F.explode(tiles("y0", ph))).withColumn("tx", F.explode(tiles("x0", pw)))
    p = p.select("patch_id", "volume_id", (F.col("z") + F.col("dz")).alias("z"), "dz", "y0", "x0", "ty", "tx")
    v = voxels.select(*C, "value", F.expr(f"cast(y div {tile} as int)").alias("ty"), F.expr(f"cast(x div {tile} as int)").alias("tx"))
    both = p.join(v, ["volume_id", "z", "ty", "tx"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + ph) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + pw))
    return both.select("patch_id", "dz", (F.col("y") - F.col("y0")).alias("py"), (F.col("x") - F.col("x0")).alias("px"), "value")


def sample_patches_by_ratio(origins: DataFrame, image: DataFrame, mask: DataFrame, ph: int, pw: int, min_image: float, min_mask: float, num: int) -> DataFrame:
    """The first num origins (patch_id, volume_id, z, y0, x0) of each volume whose patches hold enough non-zero image and mask."""
    share = lambda df, n: extract_patches(origins, df, ph, pw).where(F.col("value") != 0).groupBy("patch_id").agg((F.count("*") / F.lit(ph * pw)).alias(n))
    ok = share(image, "image").join(share(mask.select(*C, F.lit(1.0).alias("value")), "mask"), "patch_id").where((F.col("image") >= min_image) & (F.col("mask") >= min_mask))
    rank = F.row_number().over(Window.partitionBy("volume_id").orderBy("patch_id"))
    return origins.join(ok, "patch_id", "left_semi").withColumn("place", rank).where(F.col("place") <= num).drop("place")


def sample_point(mask: DataFrame, dims: DataFrame, ph: int, pw: int, t: int, seed: int) -> DataFrame:
    """(volume_id, z, y, x): one voxel of each volume by a seeded hash, moved to where a patch fits."""
    both = mask.join(dims, "volume_id")
    h = seeded((F.col("z") * F.col("h") + F.col("y")) * F.col("w") + F.col("x"), seed)
    one = both.groupBy("volume_id", "d", "h", "w").agg(F.min(F.struct(h.alias("k"), "z", "y", "x")).alias("p"))
    fit = lambda a, low, n: F.greatest(F.lit(low), F.least(F.col(n) - low - 1, F.col(f"p.{a}"))).cast("int").alias(a)
    return one.select("volume_id", fit("z", t, "d"), fit("y", ph // 2, "h"), fit("x", pw // 2, "w"))


def drop_regions(labels: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Without int(n * ratio) of each volume's components, by a seeded hash of their ids."""
    ids = labels.select("volume_id", "label").distinct()
    w = Window.partitionBy("volume_id")
    place = F.row_number().over(w.orderBy(seeded(F.col("label"), seed), "label"))
    gone = ids.withColumn("k", place).withColumn("n", F.count("*").over(w)).where(F.col("k") <= F.floor(F.col("n") * ratio)).select("volume_id", "label")
    return labels.join(written(gone, "dropped"), ["volume_id", "label"], "left_anti").select(*C, "label")


def drop_region_slices(labels: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Without max(1, int(k * ratio)) of the k slices of each component, by a seeded hash; components of one slice stay."""
    cuts = labels.select("volume_id", "label", "z").distinct()
    w = Window.partitionBy("volume_id", "label")
    place = F.row_number().over(w.orderBy(seeded(F.col("label") * 31 + F.col("z"), seed), "z"))
    cuts = cuts.withColumn("k", place).withColumn("n", F.count("*").over(w))
    gone = cuts.where((F.col("n") > 1) & (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio)))).select("volume_id", "label", "z")
    return labels.join(gone, ["volume_id", "label", "z"], "left_anti").select(*C, "label")


def sparse_annotations(df: DataFrame, dims: DataFrame, ratios: list[int], bins: int = 3, seed: int = 0, many: int = 500) -> DataFrame:
    """(ratio, C, label): for each percentage, components per value bin with slices removed, or, in volumes with `many`
    components or more, whole components removed."""
    labels = label_by_bins(value_bins(df, bins), dims)
    # components of different bins stay apart: number them by bin
    labels = labels.select(*C, (F.col("label") * bins + F.col("bin") - 1).alias("label"))
    n = labels.groupBy("volume_id").agg((F.count_distinct("label") + 1).alias("n"))
    both = labels.join(n, "volume_id")
    few, lots = both.where(F.col("n") < many).select(*C, "label"), both.where(F.col("n") >= many).select(*C, "label")
    out = None
    for r in ratios:
        part = drop_region_slices(few, r / 100, seed + r).unionByName(drop_regions(lots, r / 100, seed + r)).select(F.lit(r).alias("ratio"), *C, "label")
        out = part if out is None else out.unionByName(part)
    return out


def soften_mask(mask: DataFrame, dims: DataFrame, density: float, bias: float, seed: int, size: int = 3) -> DataFrame:
    """The mask without dilated picks: in each slice the int(density * n) voxels with the least -ln(u) / weight, where the
    weight falls off from the slice's centroid with `bias`."""
    c = mask.groupBy("volume_id", "z").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("n"))
    both = mask.join(c, ["volume_id", "z"]).join(dims, "volume_id")
    u = (seeded((F.col("z") * F.col("h") + F.col("y")) * F.col("w") + F.col("x"), seed) + 1) / 4294967297.0
    dist = F.sqrt((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2)
    key = -F.log(u) / F.exp(-bias * dist)
    place = F.row_number().over(Window.partitionBy("volume_id", "z").orderBy(key, "y", "x"))
    picks = both.withColumn("k", place).where(F.col("k") <= F.floor(F.col("n") * density)).select(*C)
    return mask.select(*C).join(dilate(picks, (1, size, size), dims), C, "left_anti")
