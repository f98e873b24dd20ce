"""Connected components of masks, and filters over them. A component's id is its smallest linear voxel index.

Tiles of a slice, or blocks of a volume, are labelled with the rim of their neighbours in one NumPy call each; components
that meet at a seam are merged as a graph of components and of the voxels that two tiles see.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.derived import C
from ..sources.store import Scratch, written
from . import blocks
from .graph import connected, roots
from .morphology import chained, closing, dilate, erode, inside, mask_except

#: Tiles of slices and blocks of volumes that one task labels at a time.
TILE = (8, 256, 256)
CUBE = (32, 128, 128)

_MET = blocks.VOXEL + ", label long, other long"


def half_steps(connectivity: int) -> list[tuple[int, int, int]]:
    """One step of each pair of opposite ones, for 4 and 8 neighbours in a slice, 6 and 26 in a volume."""
    reach = 1 if connectivity in (6, 26) else 0
    steps = [(z, y, x) for z in range(-reach, reach + 1) for y in (-1, 0, 1) for x in (-1, 0, 1) if (z, y, x) > (0, 0, 0)]
    return [s for s in steps if connectivity in (8, 26) or sum(map(abs, s)) == 1]


def _parts(on: np.ndarray, steps: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, part): the set places of a dense array, and the number of the first place of each one's component."""
    places = np.flatnonzero(on)
    ids = np.full(on.shape, -1)
    ids.reshape(-1)[places] = np.arange(len(places))
    pairs = []
    for step in steps:
        one = ids[tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(step, on.shape))]
        two = ids[tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(step, on.shape))]
        both = (one >= 0) & (two >= 0)
        pairs.append((one[both], two[both]))
    a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    return places, roots(len(places), a, b)


class _Tile:
    """The components of a block with its halo, named by the smallest index of their own voxels."""

    def __init__(self, b: blocks.Block, on: np.ndarray, steps: list[tuple[int, int, int]]):
        at, part = _parts(on, steps)
        inside = np.zeros(on.shape, bool)
        b.inner(inside)[...] = True
        self.own = inside.reshape(-1)[at]
        self.place = [c[at] for c in b.places(inside=False)]
        z, y, x = (c.astype(np.int64) for c in self.place)
        self.index = (z * b.dims[1] + y) * b.dims[2] + x
        none = np.iinfo(np.int64).max
        names = np.full(len(at), none)
        np.minimum.at(names, part[self.own], self.index[self.own])
        self.label = names[part]
        self.named = self.label < none
        self.part = part
        # own voxels that lie in a neighbour's halo
        shown = np.zeros(len(at), bool)
        for c, o, n, size, (before, after) in zip(self.place, b.origin, b.shape, b.dims, b.halo):
            shown |= (c < o + after) & (o > 0) | (c >= o + n - before) & (o + n < size)
        self.shown = shown & self.own

    def has(self, some: np.ndarray) -> np.ndarray:
        """Places whose component has one of the given places."""
        out = np.zeros(len(self.part), bool)
        out[self.part[some]] = True
        return out[self.part]

    def rows(self, b: blocks.Block, at: np.ndarray, label: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        """Rows of _MET: a voxel and its label, or a link."""
        volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.RecordBatch.from_arrays([volume, *(pa.array(c[at]) for c in self.place), pa.array(label), pa.nulls(len(at), pa.int64()) if other is None else pa.array(other)], [*C, "label", "other"])

    def links(self, b: blocks.Block) -> pa.RecordBatch:
        """A component with each of its voxels that two blocks see."""
        at = np.flatnonzero(self.named & (~self.own | self.shown & (self.index != self.label)))
        return self.rows(b, at, self.label[at], self.index[at])


def _solved(links: DataFrame, dims: DataFrame) -> DataFrame:
    """(volume_id, label, top): the smallest end of each component of links (volume_id, label, other) within volumes.

    Ends are indices of voxels, or numbers below 0, one a slice at most.
    """
    with Scratch(links.sparkSession) as passing:
        # one number for an end of a volume, in the order of the ends within it; a row a volume
        width = dims.agg(F.max((F.col("d") + 1).cast("long") * (F.col("h") * F.col("w") + 2)).alias("width"), F.max(F.col("d") + 1).cast("long").alias("low"))
        place = F.row_number().over(Window.orderBy("volume_id")).cast("long")
        codes = passing.written(dims.select("volume_id", place.alias("place")).crossJoin(F.broadcast(width)), "codes")
        code = lambda c: F.col("place") * F.col("width") + F.col("low") + F.col(c)
        found = connected(links.join(codes, "volume_id").select(code("label").alias("a"), code("other").alias("b")))
        size = codes.agg(F.max("width"), F.max("low")).first()
        wide, low = size[0] or 1, size[1] or 0
        found = found.select(F.expr(f"node div {wide}L").alias("place"), (F.col("node") % wide - low).alias("label"), (F.col("component") % wide - low).alias("top"))
        return written(found.join(codes.select("place", "volume_id"), "place").drop("place"), "tops")


def _labelled(mask: DataFrame, dims: DataFrame, connectivity: int, size: tuple[int, int, int]) -> DataFrame:
    steps = half_steps(connectivity)
    deep = int(connectivity in (6, 26))

    def f(b: blocks.Block) -> pa.RecordBatch:
        t = _Tile(b, b.present, steps)
        own = np.flatnonzero(t.own)
        both = pa.Table.from_batches([t.rows(b, own, t.label[own], None), t.links(b)]).combine_chunks()
        return (both.to_batches() or [t.rows(b, own, t.label[own], None)])[0]

    rows = mask.select(*C, F.lit(1.0).alias("value"))
    met = written(blocks.on_blocks(rows, dims, ((deep, deep), (1, 1), (1, 1)), f, _MET, size=size, border="missing"), "tiles")
    flat, links = met.where("other is null").drop("other"), met.where("other is not null").select("volume_id", "label", "other").distinct()
    if not links.head(1):
        return flat
    return flat.join(_solved(links, dims), ["volume_id", "label"], "left").select(*C, F.coalesce("top", "label").alias("label"))


def label_2d(mask: DataFrame, dims: DataFrame, connectivity: int = 4, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """(C, label) with components within slices, 4- or 8-connected. Tiles are labelled first; components that meet at
    a seam are linked there."""
    return _labelled(mask, dims, connectivity, tile)


def label_3d(mask: DataFrame, dims: DataFrame, connectivity: int = 6, tile: tuple[int, int, int] = CUBE) -> DataFrame:
    """(C, label): 6- or 26-connected over slices, in the same way from blocks."""
    return _labelled(mask, dims, connectivity, tile)


def label_by_bins(bins: DataFrame, dims: DataFrame, connectivity: int = 26) -> DataFrame:
    """(C, bin, label): components of equal bin; rows without a bin have no label."""
    keyed = bins.select(F.concat_ws("\u0001", "volume_id", F.col("bin").cast("string")).alias("volume_id"), "z", "y", "x")
    sizes = bins.select("volume_id", "bin").distinct().join(dims, "volume_id").select(F.concat_ws("\u0001", "volume_id", F.col("bin").cast("string")).alias("volume_id"), "d", "h", "w")
    out = label_3d(keyed, sizes, connectivity)
    part = F.split("volume_id", "\u0001")
    return out.select(part[0].alias("volume_id"), "z", "y", "x", part[1].cast("int").alias("bin"), "label")


def remove_small(labels: DataFrame, n: int) -> DataFrame:
    keep = labels.groupBy("volume_id", "label").count().where(F.col("count") >= n).select("volume_id", "label")
    return labels.join(keep, ["volume_id", "label"], "left_semi").select(*C, "label")


def overlap_share(labels: DataFrame, other: DataFrame) -> DataFrame:
    """(volume_id, label, size, hit): voxels of each component, and how many of them the other mask has."""
    one = other.select(*C).distinct().withColumn("one", F.lit(1))
    both = labels.join(one, C, "left")
    return both.groupBy("volume_id", "label").agg(F.count("*").alias("size"), F.count("one").alias("hit"))


def intersect_regions(m1: DataFrame, labels2: DataFrame, r: float, min_v: int = 0, max_v: int | None = None) -> DataFrame:
    """Voxels of those components of M2 (labelled) of which M1 covers a share of at least r, sizes within a range."""
    share = overlap_share(labels2, m1).where((F.col("hit") / F.col("size") >= r) & (F.col("size") >= min_v))
    share = share.where(F.col("size") <= max_v) if max_v is not None else share
    return labels2.join(share.select("volume_id", "label"), ["volume_id", "label"], "left_semi").select(*C)


def intersect_dilated(m1: DataFrame, m2: DataFrame, e: int, dims: DataFrame) -> DataFrame:
    """M2 inside M1 dilated by a cube of 2e + 1."""
    return m2.select(*C).join(dilate(m1, (2 * e + 1,) * 3, dims), C, "left_semi")


def filter_thin(labels: DataFrame, lo: int, hi: int, r: float, dims: DataFrame | None = None) -> DataFrame:
    """Components of the slices with sizes in [lo, hi] that keep a share under r after a 3 x 3 erosion."""
    core = erode(labels.select(*C), (1, 3, 3), dims=dims)
    keep = overlap_share(labels, core).where((F.col("size") >= lo) & (F.col("size") <= hi) & (F.col("hit") / F.col("size") < r))
    return labels.join(keep.select("volume_id", "label"), ["volume_id", "label"], "left_semi").select(*C)


def filter_by_line_overlap(area_labels: DataFrame, line: DataFrame, t: float, min_size: int = 20) -> DataFrame:
    """Area components of at least min_size voxels of which the line mask covers a share of at least t."""
    return intersect_regions(line, area_labels, t, min_size)


def overlap_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(volume_id, label_a, label_b, n): overlapping components of two label tables and their common voxels."""
    both = a.select(*C, F.col("label").alias("label_a")).join(b.select(*C, F.col("label").alias("label_b")), C)
    return both.groupBy("volume_id", "label_a", "label_b").agg(F.count("*").alias("n"))


def relabel_by_priority(labels: DataFrame, z: tuple[int, int], y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Labels numbered by their frequency in a box (most frequent 0, ties by label); those unseen there come after."""
    seen = labels.groupBy("volume_id", "label").agg(F.sum(F.when(F.col("z").between(z[0], z[1] - 1) & F.col("y").between(y[0], y[1] - 1) & F.col("x").between(x[0], x[1] - 1), 1).otherwise(0)).alias("n"))
    place = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("n"), "label")) - 1
    return labels.join(seen.select("volume_id", "label", place.alias("rank")), ["volume_id", "label"]).select(*C, F.col("rank").alias("label"))


def fill_holes(mask: DataFrame, dims: DataFrame, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """The mask with its holes filled."""
    return mask.select(*C).distinct().union(holes(mask, dims, tile))


def holes(mask: DataFrame, dims: DataFrame, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """The mask's holes: background that no 4-path in its slice joins to the border.

    The background of each tile falls into components: those that end within it are decided there, those that reach a
    seam are linked with their neighbours' and with the border of their slice, which has one number below 0.
    """
    steps = half_steps(4)

    def f(b: blocks.Block) -> pa.RecordBatch:
        z, y, x = b.places(inside=False)
        within = (y >= 0) & (y < b.dims[1]) & (x >= 0) & (x < b.dims[2])
        t = _Tile(b, ~b.present & within.reshape(b.present.shape), steps)
        border = (t.place[1] == 0) | (t.place[1] == b.dims[1] - 1) | (t.place[2] == 0) | (t.place[2] == b.dims[2] - 1)
        out, met = t.has(border), t.has(~t.own | t.shown)
        closed = np.flatnonzero(t.own & ~out & ~met)
        asked = np.flatnonzero(t.own & ~out & met)
        ends = np.flatnonzero(t.named & border & met)
        parts = [t.rows(b, closed, np.full(len(closed), -1), None), t.rows(b, asked, t.label[asked], None), t.links(b), t.rows(b, ends, t.label[ends], -1 - t.place[0][ends].astype(np.int64))]
        both = pa.Table.from_batches(parts).combine_chunks()
        return (both.to_batches() or parts[:1])[0]

    rows = mask.select(*C, F.lit(1.0).alias("value"))
    met = written(blocks.on_blocks(rows, dims, ((0, 0), (1, 1), (1, 1)), f, _MET, size=tile, border="missing", slices=True), "background")
    inner, links = met.where("other is null").drop("other"), met.where("other is not null").select("volume_id", "label", "other").distinct()
    if links.head(1):
        inner = inner.join(_solved(links, dims).where("top < 0 and label >= 0").select("volume_id", "label"), ["volume_id", "label"], "left_anti")
    return inner.select(*C)


def closed_region_fill(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """Close 3 x 3 twice, take the interiors (background that cannot reach the border) without the lines that close them,
    open 3 x 3 twice."""
    twice = [(grow, (1, 3, 3), 2) for grow in (True, False)]
    closed = written(chained(mask, dims, twice), "closed")
    return chained(holes(closed, dims), dims, twice[::-1])


def edge_regions(df: DataFrame, dims: DataFrame, threshold: float = 0.7, lo: int = 100, hi: int = 20_000, r: float = 0.4) -> DataFrame:
    """Scale to at most 1 by volume, threshold, keep thin components of the slices with lo to hi pixels, fill the regions
    they close."""
    top = written(df.groupBy("volume_id").agg(F.max("value").alias("m")), "tops")
    high = df.join(top, "volume_id").where(F.col("value") > threshold * F.greatest(F.col("m"), F.lit(1.0))).select(*C)
    return closed_region_fill(filter_thin(written(label_2d(high, dims), "lines"), lo, hi, r, dims), dims)


def refine_label(labels: DataFrame, target: int, dims: DataFrame, factor: int = 4, close: int = 7, min_area: int = 16) -> DataFrame:
    """One class: nearest down- and up-scaling by factor, closing by a square, small components of slices dropped."""
    centre = (F.col("y") % factor == factor // 2) & (F.col("x") % factor == factor // 2)
    picked = labels.where((F.col("label") == target) & centre).select("volume_id", "z", F.expr(f"y div {factor}").alias("ty"), F.expr(f"x div {factor}").alias("tx"))
    around = F.sequence(F.lit(0), F.lit(factor - 1))
    wide = picked.withColumn("oy", F.explode(around)).withColumn("ox", F.explode(around))
    wide = wide.select("volume_id", "z", (F.col("ty") * factor + F.col("oy")).cast("int").alias("y"), (F.col("tx") * factor + F.col("ox")).cast("int").alias("x"))
    return remove_small(label_2d(closing(inside(wide, dims), (1, close, close), dims), dims), min_area).select(*C)
