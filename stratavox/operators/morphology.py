"""Binary morphology on sparse coordinate sets (a row for every voxel that is set).

Where the volumes' sizes are known, a chain of dilations and erosions by boxes works on blocks with halos: one exchange for
all of its steps, and no row but a voxel's. Without them an erosion counts the offsets found, axis by axis.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.derived import C
from . import blocks
from .windows import frame

_LENGTH = {"z": "d", "y": "h", "x": "w"}


def _shifted(mask: DataFrame, axis: str, offsets: Column) -> DataFrame:
    others = [c for c in C if c != axis]
    return mask.select(*others, F.explode(F.transform(offsets, lambda o: F.col(axis) + o)).alias(axis)).select(*C)


def inside(mask: DataFrame, dims: DataFrame) -> DataFrame:
    both = mask.join(dims, "volume_id")
    for axis, n in _LENGTH.items():
        both = both.where((F.col(axis) >= 0) & (F.col(axis) < F.col(n)))
    return both.select(*C)


#: A step of a chain: grow (or shrink), the box's sizes by (z, y, x), how often.
Step = tuple[bool, tuple[int, int, int], int]


def _reach(step: Step) -> list[tuple[int, int]]:
    """How far before and after a voxel a step looks, by axis. Boxes in a row are one larger box."""
    grow, size, times = step
    ends = [frame(n) if n > 1 else (0, 0) for n in size]
    return [(b * times, a * times) if grow else (a * times, b * times) for a, b in ends]


def _within(b: blocks.Block, spare: list[tuple[int, int]]) -> np.ndarray:
    """The places of a block, with `spare` around it, that lie in its volume."""
    axes = [np.arange(o - before, o + n + after) for o, n, (before, after) in zip(b.origin, b.shape, spare)]
    z, y, x = ((a >= 0) & (a < n) for a, n in zip(axes, b.dims))
    return z[:, None, None] & y[None, :, None] & x[None, None, :]


def stepped(b: blocks.Block, steps: list[Step]) -> np.ndarray:
    """A block's own voxels after a chain of steps, whose halo it has. What lies outside of the volume is unset."""
    spare = [(sum(_reach(s)[k][0] for s in steps), sum(_reach(s)[k][1] for s in steps)) for k in range(3)]
    on = b.present[tuple(slice(h0 - s0, h0 + n + s1) for (h0, _), (s0, s1), n in zip(b.halo, spare, b.shape))]
    for step in steps:
        reach = _reach(step)
        for axis, (before, after) in enumerate(reach):
            on = blocks.slid(on, axis, before + after + 1, np.logical_or if step[0] else np.logical_and)
        spare = [(s0 - r0, s1 - r1) for (s0, s1), (r0, r1) in zip(spare, reach)]
        on = on & _within(b, spare)
    return on


def chained(mask: DataFrame, dims: DataFrame, steps: list[Step]) -> DataFrame:
    """The mask after a chain of dilations and erosions."""
    halo = tuple((sum(_reach(s)[k][0] for s in steps), sum(_reach(s)[k][1] for s in steps)) for k in range(3))
    return by_block(mask, dims, halo, lambda b: blocks.voxel_rows(b, {}, stepped(b, steps)), blocks.VOXEL)


def by_block(mask: DataFrame, dims: DataFrame, halo: tuple, f: Callable[[blocks.Block], pa.RecordBatch], schema: str) -> DataFrame:
    return blocks.on_blocks(mask.select(*C, F.lit(1.0).alias("value")), dims, halo, f, schema, border="missing")


def dilate(mask: DataFrame, size: tuple[int, int, int], dims: DataFrame, iters: int = 1) -> DataFrame:
    """Box of (z, y, x) sizes; an even size reaches one further to the lower side, so that it undoes the erosion's shift."""
    return chained(mask, dims, [(True, size, iters)]) if iters else mask.select(*C).distinct()


def erode(mask: DataFrame, size: tuple[int, int, int], iters: int = 1, dims: DataFrame | None = None) -> DataFrame:
    """Box erosion; outside of the volume counts as unset."""
    mask = mask.select(*C)
    if dims is not None:
        return chained(mask, dims, [(False, size, iters)])
    for _ in range(iters):
        for axis, n in zip("zyx", size):
            if n > 1:
                a, b = frame(n)
                hits = _shifted(mask, axis, F.sequence(F.lit(-b), F.lit(a)))
                mask = hits.groupBy(*C).agg(F.count("*").alias("n")).where(F.col("n") == n).select(*C)
    return mask


def opening(mask: DataFrame, size: tuple[int, int, int], dims: DataFrame) -> DataFrame:
    return chained(mask, dims, [(False, size, 1), (True, size, 1)])


def closing(mask: DataFrame, size: tuple[int, int, int], dims: DataFrame) -> DataFrame:
    return chained(mask, dims, [(True, size, 1), (False, size, 1)])


def dilate_diamond(mask: DataFrame, r: int, dims: DataFrame) -> DataFrame:
    """Voxels within a city-block distance r: the cross, iterated."""
    offsets = [(dz, dy, dx) for dz in range(-r, r + 1) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if abs(dz) + abs(dy) + abs(dx) <= r]
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("y"), F.lit(c).alias("x")) for a, b, c in offsets]))
    moved = mask.withColumn("o", steps).select("volume_id", *[(F.col(a) + F.col(f"o.{a}")).alias(a) for a in "zyx"])
    return inside(moved.distinct(), dims)


def erode_open_border(mask: DataFrame, size: tuple[int, int, int], dims: DataFrame) -> DataFrame:
    """Erosion that ignores what lies outside of the volume."""
    both = mask.join(dims, "volume_id")
    for axis, n in zip("zyx", size):
        if n > 1:
            a, b = frame(n)
            others = [c for c in both.columns if c != axis]
            hits = both.select(*others, F.explode(F.transform(F.sequence(F.lit(-b), F.lit(a)), lambda o: F.col(axis) + o)).alias(axis))
            length = F.col(_LENGTH[axis])
            need = F.least(F.col(axis) + b, length - 1) - F.greatest(F.col(axis) - a, F.lit(0)) + 1
            both = hits.groupBy(*both.columns).agg(F.count("*").alias("n")).where((F.col(axis) >= 0) & (F.col(axis) < length) & (F.col("n") == need)).drop("n")
    return both.select(*C)


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*C).unionByName(b.select(*C)).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*C).intersect(b.select(*C))


def mask_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*C).join(b.select(*C), C, "left_anti").distinct()


def mask_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """Voxels of exactly one mask, by one grouping instead of two anti-joins."""
    tagged = a.select(*C, F.lit(1).alias("s")).unionByName(b.select(*C, F.lit(2).alias("s")))
    return tagged.groupBy(*C).agg(F.bit_or("s").alias("s")).where("s < 3").select(*C)


def edge_mask(mask: DataFrame, width: int, dims: DataFrame) -> DataFrame:
    """In-plane band around the border: dilation xor erosion by a 3 x 3 square, `width` times each."""
    return mask_xor(dilate(mask, (1, 3, 3), dims, width), erode(mask, (1, 3, 3), width, dims))


def dilated_rings(mask: DataFrame, dims: DataFrame, k: int = 3, e: int = 4) -> DataFrame:
    """(C, ring): `edge`, `eroded`, `inner` = dilation by k without the mask, `outer` = dilation by k + e without that by k.

    Squares of 2k + 1 in the plane; erosion ignores the border. All rings come from one exchange.
    """
    wide = max(k + e, 1)

    def f(b: blocks.Block) -> pa.RecordBatch:
        here = b.inner(b.present)
        near, far = (stepped(b, [(True, (1, 2 * r + 1, 2 * r + 1), 1)]) for r in (k, k + e))
        free = b.present | ~_within(b, [(0, 0), (wide, wide), (wide, wide)])
        small = here & blocks.slid(blocks.slid(free[:, wide - 1 : free.shape[1] - wide + 1, wide - 1 : free.shape[2] - wide + 1], 1, 3, np.logical_and), 2, 3, np.logical_and)
        rings = {"edge": here & ~small, "eroded": small, "inner": near & ~here, "outer": far & ~near}
        parts = [blocks.voxel_rows(b, {}, keep) for keep in rings.values()]
        parts = [pa.RecordBatch.from_arrays([*p.columns, pa.array([name] * p.num_rows, pa.string())], [*C, "ring"]) for name, p in zip(rings, parts)]
        both = pa.Table.from_batches(parts).combine_chunks()
        return (both.to_batches() or parts[:1])[0]

    return by_block(mask, dims, ((0, 0), (wide, wide), (wide, wide)), f, blocks.VOXEL + ", ring string")
