"""Matching of regions to template regions by shape.

Templates may be many, and so may copies of a vector: distinct vectors are compared, and their regions found again by the
vector. Most candidates fit one of a few templates, which they meet first; the rest meet all those of the same bands of a few
elements in an equi-join (a template is listed at the two or three bands its tolerance reaches), and the exact test follows.
Grids of 3-D shapes are compared with the templates' grids in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import all_within_rel, cosine, norm
from ..sources.derived import C
from ..sources.store import Scratch, written
from .components import intersect_regions, label_3d

R = ["volume_id", "label"]
#: Templates that candidates meet first.
FIRST = 1024
#: Templates whose grids, and cells of their grids, that one pass over the candidates holds.
TEMPLATES_PER_PASS = 2048
CELLS_PER_PASS = 2_000_000
#: Regions of one vector that stand on either side of a block of pairs.
MEMBERS = 2_000
#: Pairs that one task writes out.
PAIRS_PER_TASK = 5_000_000


def _relative_bands(v: Column, tol: float) -> Column:
    """The band of a value of at least 0, and -1 for 0: a value within tol of a template, relative to it, lies in one of
    the template's bands."""
    width = math.log((1 + tol) / (1 - tol))
    return F.when(v > 0, F.floor(F.log(v) / width) + 1_000_000).otherwise(-1)


def _within_bands(cand: DataFrame, templates: DataFrame, tol: float, elements: list[int]) -> DataFrame:
    """Pairs of candidates and templates (column tv) that agree in the relative bands of some elements of v."""
    names = [f"b{k}" for k in elements]
    left = cand.withColumns({n: _relative_bands(F.col("v")[k], tol) for n, k in zip(names, elements)})
    right = templates
    for n, k in zip(names, elements):
        t = F.col("tv")[k]
        ends = [_relative_bands(t * (1 - tol) - F.lit(1e-8), tol), _relative_bands(t * (1 + tol) + F.lit(1e-8), tol)]
        right = right.withColumn(n, F.explode(F.array_distinct(F.array(*ends, *([F.lit(-1)] if tol >= 1 else []), ends[0] + 1))))
    return left.join(right.dropDuplicates([*names, "tv"]), names).drop(*names)


def _fits_one(vectors: DataFrame, templates: DataFrame, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """vectors (v) with a column `fits`: whether v fits one of the FIRST templates (tv). It decides yes alone; where it
    says no, all templates are still to be met.

    fits(v, t): for vectors v (n, m) and templates t (k, m), (n, k), true only where the exact test is.
    """
    first = [r.tv for r in templates.orderBy(F.xxhash64("tv"), "tv").limit(FIRST).collect()]
    first = [t for t in first if None not in t and len(t) == len(first[0])]
    some = np.array(first, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            out = np.zeros(len(col), bool)
            flat, length = col.flatten(), pc.list_value_length(col)
            if len(some) and not flat.null_count and pc.all(pc.equal(length, some.shape[1])).as_py():
                v = flat.to_numpy().astype(float).reshape(len(col), -1)
                for i in range(0, len(v), 512):
                    out[i : i + 512] = fits(v[i : i + 512], some).any(1)
            yield pa.RecordBatch.from_arrays([col, pa.array(out)], ["v", "fits"])

    return vectors.mapInArrow(run, "v array<double>, fits boolean")


def _near_all(tol: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def fits(v: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.ones((len(v), len(t)), bool)
        for k in range(t.shape[1]):
            out &= np.abs(v[:, k : k + 1] - t[:, k]) / (np.abs(t[:, k]) + 1e-8) <= tol
        return out

    return fits


def _near_cosine(least: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A little above the bound: sums in another order must not decide."""

    def fits(v: np.ndarray, t: np.ndarray) -> np.ndarray:
        length = np.sqrt((v * v).sum(1))[:, None] * np.sqrt((t * t).sum(1)) + 1e-8
        return v @ t.T / length >= least + 1e-9

    return fits


def _fitting(cand: DataFrame, templates: DataFrame, fits: Callable[[np.ndarray, np.ndarray], np.ndarray], pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Regions of cand (R, v) whose vector fits a template (tv): fits decides for a few templates, pairs(open) gives the
    vectors v among the rest that fit any."""
    cand = written(cand, "candidates")
    met = written(_fits_one(cand.select("v").distinct(), templates, fits), "met")
    hit = met.where("fits").select("v")
    if met.where("not fits").head(1):
        hit = hit.union(written(pairs(met.where("not fits").select("v")).select("v").distinct(), "fitting"))
    return cand.join(hit, "v", "left_semi").select(*R).distinct()


def match_shapes(cand: DataFrame, templates: DataFrame, threshold: float, min_ratio: float) -> DataFrame:
    """Regions (volume_id, label) whose vector fits a template and the templates' range.

    cand, templates: (volume_id, label, size, euler, v). With tol = 1 - threshold, some template differs by at most tol
    in every element, and every element lies within (1 + tol) / 2 of the templates' range around their mean. Candidates
    have Euler number 1 and sizes from min * min_ratio to max / min_ratio.
    """
    tol = 1 - threshold
    n = 9
    parts = [F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(n)] + [(F.max(F.col("v")[k]) - F.min(F.col("v")[k])).alias(f"r{k}") for k in range(n)]
    stats = templates.agg(F.min("size").alias("lo"), F.max("size").alias("hi"), *parts)
    stats = stats.select("lo", "hi", F.array(*[f"m{k}" for k in range(n)]).alias("mean"), F.array(*[f"r{k}" for k in range(n)]).alias("range"))
    both = cand.where("euler = 1").join(F.broadcast(stats), (F.col("size") >= F.col("lo") * min_ratio) & (F.col("size") <= F.col("hi") / min_ratio))
    near = F.forall(F.arrays_zip("v", "mean", "range"), lambda t: F.abs(t["v"] - t["mean"]) < (1 + tol) / 2 * (t["range"] + F.lit(1e-8)))
    t = written(templates.select(F.col("v").alias("tv")).distinct(), "shapes")

    def pairs(rest: DataFrame) -> DataFrame:
        # none is negative; the last two Hu numbers tell most apart
        both = _within_bands(rest, t, max(tol, 1e-6), [7, 8, 1]) if tol < 1 else rest.crossJoin(t)  # beyond 1 all but fits
        return both.where(all_within_rel(F.col("v"), F.col("tv"), tol))

    return _fitting(both.where(near).select(*R, "v"), t, _near_all(tol), pairs)


def filter_by_shape(cand_labels: DataFrame, cand: DataFrame, templates: DataFrame, threshold: float, min_ratio: float, dims: DataFrame | None = None, max_height: int = 0) -> DataFrame:
    """Voxels of the matching slice regions; with max_height > 5, of the whole 3-D components of the input that they
    cover by a tenth, of sizes up to the largest template times max_height."""
    hit = cand_labels.join(match_shapes(cand, templates, threshold, min_ratio), R, "left_semi").select(*C)
    if max_height <= 5:
        return hit
    ends = templates.agg(F.min("size"), F.max("size")).first()
    return intersect_regions(hit, label_3d(cand_labels.select(*C), dims, 6), 0.1, ends[0], ends[1] * max_height)


def signed_log(c: Column) -> Column:
    return -F.signum(c) * F.log10(F.abs(c) + F.lit(1e-10))


def hu_vector() -> Column:
    return F.array(*[signed_log(F.col(f"hu{k}")) for k in range(1, 8)])


def _alike(a: DataFrame, b: DataFrame, t: float, on: list[str]) -> DataFrame:
    """Pairs (va from a, vb from b) of equal columns `on` whose cosine can be t or more.

    The unit vectors of such a pair differ by at most sqrt(2 - 2t) in every element: the pair shares a cell of three
    elements, those in which b's differ most, cells being that wide and b listed at the neighbours of its cell.
    """
    wide = max(math.sqrt(max(0.0, 2 - 2 * t)), 1e-3) + 1e-6
    of = lambda v, k: F.coalesce(F.try_divide(F.get(v, F.lit(k)), norm(v)), F.lit(0.0))
    length = b.agg(F.max(F.size("vb"))).first()[0] or 0
    spread = b.agg(F.lit(0.0), *[F.stddev_pop(of(F.col("vb"), k)) for k in range(length)]).first()[1:]
    best = sorted(range(length), key=lambda k: -(spread[k] or 0.0))[:3]
    cells = [f"c{k}" for k in best]
    for k, c in zip(best, cells):
        at = lambda v: F.floor(of(v, k) / wide)  # noqa: B023, E731
        a = a.withColumn(c, at(F.col("va")))
        b = b.withColumn(c, F.explode(F.array(*[at(F.col("vb")) + d for d in (-1, 0, 1)])))
    return (a.join(b, [*on, *cells]) if on or cells else a.crossJoin(b)).drop(*cells)


def filter_by_hu(cand: DataFrame, templates: DataFrame, t: float, min_ratio: float, min_size: int = 10) -> DataFrame:
    """Regions of at least min_size whose vector v has a cosine of at least t with some template's."""
    ends = templates.agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    rows = cand.where(F.col("size") >= min_size).join(F.broadcast(ends), (F.col("size") >= F.col("lo") * min_ratio) & (F.col("size") <= F.col("hi") / min_ratio))
    shapes = written(templates.select(F.col("v").alias("tv")).distinct(), "shapes")

    def pairs(rest: DataFrame) -> DataFrame:
        both = _alike(rest.select(F.col("v").alias("va")), shapes.select(F.col("tv").alias("vb")), t, [])
        return both.where(cosine(F.col("va"), F.col("vb")) >= t).select(F.col("va").alias("v"))

    return _fitting(rows.select(*R, "v"), shapes, _near_cosine(t), pairs)


filter_by_geometry = filter_by_hu


def hu_similarity(a: DataFrame, b: DataFrame, least: float = 0.999) -> DataFrame:
    """(volume_id, label_a, label_b, sim): pairs of regions of a volume whose Hu vectors have a cosine of at least `least`,
    clipped to 0..1."""
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("va"), F.col("vb"))))
    a, b = _members(a, "a"), _members(b, "b")
    classes = lambda df, k: df.select("volume_id", f"v{k}", f"parts_{k}").distinct()
    near = _alike(classes(a, "a"), classes(b, "b"), least, ["volume_id"]).withColumn("sim", sim).where(F.col("sim") >= least)
    part = lambda k: F.explode(F.sequence(F.lit(0), F.col(f"parts_{k}") - 1))
    near = near.withColumn("part_a", part("a")).withColumn("part_b", part("b"))
    for k, df in (("a", a), ("b", b)):
        near = near.join(df.drop(f"parts_{k}"), ["volume_id", f"v{k}", f"part_{k}"]).drop(f"v{k}", f"part_{k}")
    near = written(near, "blocks")
    # blocks of pairs are small as they are and large as rows: dealt evenly
    n = near.agg(F.sum(F.size("labels_a").cast("double") * F.size("labels_b"))).first()[0] or 0
    near = near.repartition(max(12, min(20_000, int(n / PAIRS_PER_TASK) + 1)))
    return near.withColumn("label_a", F.explode("labels_a")).withColumn("label_b", F.explode("labels_b")).select("volume_id", "label_a", "label_b", "sim")


def _members(df: DataFrame, k: str) -> DataFrame:
    """(volume_id, v, parts, part, labels), names ending in k: the regions of each vector, in parts of about MEMBERS."""
    key = ["volume_id", f"v{k}"]
    df = df.select("volume_id", "label", F.col("v").alias(f"v{k}"))
    n = df.groupBy(*key).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias(f"parts_{k}"))
    part = F.pmod(F.xxhash64("label"), F.col(f"parts_{k}")).cast("int").alias(f"part_{k}")
    parts = df.join(n, key).groupBy(*key, f"parts_{k}", part).agg(F.collect_list("label").alias(f"labels_{k}"))
    return written(parts, "members")


SIDE = 32


def _axes(moments: DataFrame) -> DataFrame:
    """(R, centre, axes): the principal axes of every region, widest first, from its moments; a row a region."""
    pairs = ["zz", "zy", "zx", "yy", "yx", "xx"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            c = {p: f[p].to_numpy(float) for p in pairs}
            m = np.stack([np.stack([c["zz"], c["zy"], c["zx"]], -1), np.stack([c["zy"], c["yy"], c["yx"]], -1), np.stack([c["zx"], c["yx"], c["xx"]], -1)], -2)
            vec = np.linalg.eigh(m)[1][:, :, ::-1]
            yield f[[*R, "size", "cz", "cy", "cx"]].assign(axes=list(vec.transpose(0, 2, 1).reshape(len(f), 9)))

    centre = moments.groupBy(*R).agg(F.count("*").alias("size"), *[F.avg(a).alias(f"c{a}") for a in "zyx"], *[F.covar_samp(F.col(p[0]).cast("double"), F.col(p[1]).cast("double")).alias(p) for p in pairs])
    schema = "volume_id string, label long, size long, cz double, cy double, cx double, axes array<double>"
    return centre.where("size > 1").mapInPandas(run, schema)


def shape_cells(labels: DataFrame) -> DataFrame:
    """(volume_id, label, size, cell): occupied cells of a SIDE^3 grid by every region's voxels, turned to its principal axes
    (each towards its longer tail) and scaled by their largest extent; regions without an extent have none.

    Moments, extents and cells are aggregates over voxels, so a region of any size is spread.
    """
    axes = written(_axes(labels), "axes")
    d = [F.col(a) - F.col(f"c{a}") for a in "zyx"]
    turned = [sum((d[j] * F.col("axes")[3 * k + j] for j in range(1, 3)), d[0] * F.col("axes")[3 * k]) for k in range(3)]
    rows = labels.join(axes, R).select(*R, "size", *[t.alias(f"p{k}") for k, t in enumerate(turned)])
    reach = F.greatest(*[F.abs(F.col(f"p{k}")) for k in range(3)])
    scale = written(rows.groupBy(*R).agg(F.max(reach).alias("top"), *[F.sum(F.col(f"p{k}") ** 3).alias(f"t{k}") for k in range(3)]), "scales")
    rows = rows.join(scale.where("top >= 1e-5"), R)
    at = [F.greatest(F.lit(0), F.least(F.lit(SIDE - 1), F.rint((F.when(F.col(f"t{k}") < 0, -F.col(f"p{k}")).otherwise(F.col(f"p{k}")) / F.col("top") + 1) * (SIDE - 1) / 2))).cast("long") for k in range(3)]
    return rows.select(*R, "size", ((at[0] * SIDE + at[1]) * SIDE + at[2]).alias("cell")).distinct()


def filter_by_shape_3d(labels: DataFrame, templates: DataFrame, t: float = 0.1, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """Regions within the templates' size band whose best Dice of aligned grids with a template is at least t.

    A grid is at most SIDE^3 cells; equal grids count once. The templates' are sent to the candidates that fit none so far,
    TEMPLATES_PER_PASS or CELLS_PER_PASS at a time.
    """
    place = F.col("cell").cast("int")
    grids = lambda cells: cells.groupBy(*R, "size").agg(F.sort_array(F.collect_list(place)).alias("cells"))
    with Scratch(labels.sparkSession) as passing:
        a, b = passing.written(grids(shape_cells(labels)), "grids"), passing.written(grids(shape_cells(templates)), "templates")
        ends = b.agg(F.min("size").alias("lo"), F.max("size").alias("hi")).first()
        a = a.where((F.col("size") >= (ends["lo"] or 0) * low) & (F.col("size") <= (ends["hi"] or 0) * high)).select(*R, "cells")
        shapes = passing.written(b.select("cells").distinct(), "shapes")
        n, total = shapes.agg(F.count("*"), F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()
        passes = max(-(-n // TEMPLATES_PER_PASS), -(-total // CELLS_PER_PASS))
        left, found = passing.written(a.select("cells").distinct(), "open"), []
        for k in range(passes):
            block = shapes.where(F.pmod(F.xxhash64("cells"), F.lit(passes)) == k).toArrow().column(0).combine_chunks()
            size = pc.list_value_length(block).to_numpy().astype(np.int64)
            cell, first = block.flatten().to_numpy(), np.cumsum(size) - size

            def run(batches: Iterator[pa.RecordBatch], size: np.ndarray = size, cell: np.ndarray = cell, first: np.ndarray = first) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    keep = np.zeros(batch.num_rows, bool)
                    for i, x in enumerate(batch.column(0)):
                        own = np.zeros(SIDE**3, np.uint16)
                        own[np.asarray(x.values)] = 1
                        if len(size):
                            both = np.add.reduceat(own[cell], first, dtype=np.int64)
                            keep[i] = (2 * both / (size + int(own.sum(dtype=np.int64))) >= t).any()
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keep)], ["cells", "fits"])

            met = passing.written(left.mapInArrow(run, "cells array<int>, fits boolean"), "met")
            found.append(met.where("fits").select("cells"))
            left = met.where("not fits").select("cells")
            if not left.head(1):
                break
        out = a.limit(0)
        for f in found:
            out = out.union(a.join(f, "cells", "left_semi").select(*a.columns))
        return written(out.select(*R).distinct(), "fitting")


def pca_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, label, iou): aligned grids of equally numbered regions of two label tables."""
    x, y = shape_cells(a).select(*R, "cell", F.lit(1).alias("s")), shape_cells(b).select(*R, "cell", F.lit(2).alias("s"))
    cells = x.unionByName(y).groupBy(*R, "cell").agg(F.sum("s").alias("s"))
    return cells.groupBy(*R).agg((F.sum(F.when(F.col("s") == 3, 1).otherwise(0)) / F.count("*")).alias("iou"))


def fill_edge_boxes(labels: DataFrame, hulls: DataFrame, min_size: int = 5, times: float = 3.0) -> DataFrame:
    """The boxes (C) of hollow lines: regions of at least min_size whose hull has `times` their size or more.

    hulls: region_solidity of labels.
    """
    from .regions import region_basics

    keep = hulls.where((F.col("size") >= min_size) & (F.col("hull") >= times * F.col("size"))).select(*R)
    box = region_basics(labels).join(keep, R, "left_semi")
    cells = box.withColumn("z", F.explode(F.sequence(F.col("z0"), F.col("z1") - 1))).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    return cells.select(*C).distinct()


def filter_by_perimeter_ratio(area_perimeters: DataFrame, line_perimeters: DataFrame, pairs: DataFrame, lo: float = 1.8, hi: float = 2.2) -> DataFrame:
    """Area regions with an overlapping line region of lo to hi times their perimeter (perimeters: R, perimeter; those of
    regions over several slices are sums over slices). Regions without a perimeter fit none."""
    a = area_perimeters.select("volume_id", F.col("label").alias("label_a"), F.col("perimeter").alias("pa"))
    b = line_perimeters.select("volume_id", F.col("label").alias("label_b"), F.col("perimeter").alias("pb"))
    both = pairs.select("volume_id", "label_a", "label_b").join(a, ["volume_id", "label_a"]).join(b, ["volume_id", "label_b"])
    ratio = F.col("pb") / (F.col("pa") + F.lit(1e-6))
    both = both.where("pa > 0 and pb > 0")
    return both.where((ratio >= lo) & (ratio <= hi)).select("volume_id", F.col("label_a").alias("label")).distinct()
