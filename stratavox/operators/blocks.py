"""Blocks of voxels with their neighbours' borders (halos), made by one exchange.

Voxel rows are packed in the task that reads them: for each block that they touch, with its halo, one row of local
places and values (12 bytes a voxel in place of a row). One exchange brings a block's packs together, and a NumPy function
works on the dense block; what it gives for the block's own voxels leaves as rows again. A block's size is chosen by the
caller, so a task holds one block, whatever the volume. Beyond the ends of a volume blocks are mirrored (d c b a | a b c d
| d c b a), repeat the end, or hold a constant.

dims (volume_id, d, h, w) is a row a volume. Voxels missing in a block that others touch count as `missing`; blocks that no
voxel touches do not arise, unless `slices` asks for all blocks of the slices that have a voxel. Of repeated voxels one counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.derived import C

#: Bytes of rows that a task packs together.
PACKED = 4 << 20
#: A block's edge along an axis that takes the whole axis.
WHOLE = 1 << 30
SIZE = (32, 128, 128)

Pair = tuple[int, int]


@dataclass
class Block:
    """values: (z, y, x) or (z, y, x, k) with the halo; origin: of the block itself; dims: of its volume."""

    volume_id: str
    origin: tuple[int, int, int]
    dims: tuple[int, int, int]
    halo: tuple[Pair, Pair, Pair]
    shape: tuple[int, int, int]
    values: np.ndarray
    present: np.ndarray | None = field(default=None, repr=False)

    def inner(self, a: np.ndarray) -> np.ndarray:
        """The block's own part of an array with the halo."""
        return a[tuple(slice(b, b + n) for (b, _), n in zip(self.halo, self.shape))]

    def places(self, inside: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Coordinates of all own voxels in row-major order; of all with the halo if not inside."""
        low = [0 if inside else b for b, _ in self.halo]
        n = self.shape if inside else self.values.shape[:3]
        return tuple((x.reshape(-1) - b + o).astype(np.int32) for x, b, o in zip(np.indices(n), low, self.origin))


def _edges(size: int, n: np.ndarray) -> np.ndarray:
    return np.minimum(size, np.maximum(n, 1))


def _packs(rows: pa.Table, size: tuple[int, int, int], halo: tuple[Pair, Pair, Pair]) -> pa.RecordBatch:
    """(volume_id, d, h, w, bz, by, bx, at, value) of rows (volume_id, d, h, w, z, y, x, value): packs by block."""
    volume = rows.column(0).combine_chunks().dictionary_encode()
    code = volume.indices.to_numpy().astype(np.int64)
    dims = [rows.column(k).to_numpy().astype(np.int64) for k in (1, 2, 3)]
    at = [rows.column(k).to_numpy().astype(np.int64) for k in (4, 5, 6)]
    value = rows.column(7).combine_chunks()
    if pa.types.is_list(value.type):
        value = value.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(code), -1)
    else:
        value = value.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 1)
    # voxels outside of their volume belong to no block
    which = np.flatnonzero(np.logical_and.reduce([(p >= 0) & (p < n) for p, n in zip(at, dims)]))
    block, local = [], []
    for p, n, s, (before, after) in zip(at, dims, size, halo):
        edge, p, last = _edges(s, n)[which], p[which], ((n - 1) // _edges(s, n))[which]
        low = np.maximum(0, (p - after) // edge)
        high = np.minimum(last, (p + before) // edge)
        times = np.maximum(0, high - low + 1)
        spread = np.repeat(np.arange(len(which)), times)
        k = low[spread] + np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
        block, local = [b[spread] for b in block], [x[spread] for x in local]
        block.append(k)
        local.append(p[spread] - k * edge[spread] + before)
        which = which[spread]
    length = [np.minimum(_edges(s, n[which]), n[which]) + b + a for n, s, (b, a) in zip(dims, size, halo)]
    place = (local[0] * length[1] + local[1]) * length[2] + local[2]
    order = np.lexsort((place, block[2], block[1], block[0], code[which]))
    keys = [code[which][order], *(b[order] for b in block)]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    cuts = np.append(first, len(order))
    place, data = place[order].astype(np.int64), value[which[order]]
    binary = lambda a, width: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts.astype(np.int64) * width), pa.py_buffer(np.ascontiguousarray(a))]).cast(pa.binary())
    rows_of = which[order][first]
    cols = [volume.dictionary.take(pa.array(keys[0][first])), *(pa.array(n[rows_of].astype(np.int32)) for n in dims), *(pa.array(k[first].astype(np.int32)) for k in keys[1:]), binary(place, 8), binary(data, 8 * value.shape[1])]
    return pa.RecordBatch.from_arrays(cols, ["volume_id", "d", "h", "w", "bz", "by", "bx", "at", "value"])


_PACK = "volume_id string, d int, h int, w int, bz int, by int, bx int, at binary, value binary"


def packed(df: DataFrame, dims: DataFrame, col: str, size: tuple[int, int, int], halo: tuple[Pair, Pair, Pair]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n >= PACKED:
                yield _packs(pa.Table.from_batches(held), size, halo)
                held, n = [], 0
        if n:
            yield _packs(pa.Table.from_batches(held), size, halo)

    rows = df.join(dims.select("volume_id", "d", "h", "w"), "volume_id")
    return rows.select("volume_id", "d", "h", "w", "z", "y", "x", F.col(col).alias("value")).mapInArrow(run, _PACK)


def _outside(n: int, edge: int, k: int, before: int, after: int, border: str) -> np.ndarray:
    """For each place of a block with its halo along an axis, the place that it takes its value from (-1: none)."""
    own = min(edge, n)
    low = k * edge - before
    p = low + np.arange(own + before + after)
    if border == "mirror":
        m = np.mod(p, 2 * n)
        p = np.where(m < n, m, 2 * n - 1 - m)
    elif border == "edge":
        p = np.clip(p, 0, n - 1)
    else:
        p = np.where((p >= 0) & (p < n), p, low - 1)
    return np.where((p - low < own + before + after) & (p >= low), p - low, -1)


def _block(key: tuple, parts: list[tuple[bytes, bytes]], size: tuple[int, int, int], halo: tuple[Pair, Pair, Pair], border: str, missing: float) -> Block:
    volume, *rest = key
    dims, k = tuple(rest[:3]), rest[3:]
    edges = [min(s, max(n, 1)) for s, n in zip(size, dims)]
    shape = [min(e, n) + b + a for e, n, (b, a) in zip(edges, dims, halo)]
    at = np.concatenate([np.frombuffer(p, np.int64) for p, _ in parts])
    data = np.concatenate([np.frombuffer(v, np.float64) for _, v in parts]).reshape(len(at), -1) if len(at) else np.zeros((0, 1))
    values = np.full((int(np.prod(shape)), data.shape[1]), missing)
    values[at] = data
    present = np.zeros(len(values), bool)
    present[at] = True
    values, present = values.reshape(*shape, -1), present.reshape(shape)
    maps = [_outside(n, e, j, b, a, border) for n, e, j, (b, a) in zip(dims, edges, k, halo)]
    if any((m != np.arange(len(m))).any() for m in maps):
        grid = np.ix_(*[np.maximum(m, 0) for m in maps])
        values, present = values[grid], present[grid]
        for axis, m in enumerate(maps):
            gone = tuple(m < 0 if x == axis else slice(None) for x in range(3))
            values[gone], present[gone] = missing, False
    own = tuple(min(e, n - j * e) for e, n, j in zip(edges, dims, k))
    # the last block of an axis may be shorter than the rest: its halo begins where it ends
    cut = tuple(slice(0, b + o + a) for o, (b, a) in zip(own, halo))
    values = values[cut]
    return Block(volume, tuple(j * e for j, e in zip(k, edges)), dims, halo, own, values[..., 0] if values.shape[-1] == 1 else values, present[cut])


def _all_blocks(df: DataFrame, dims: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Empty packs of every block of the slices with a voxel."""
    slices = df.select("volume_id", "z").distinct().join(dims.select("volume_id", "d", "h", "w"), "volume_id").where("z >= 0 and z < d")
    edge = lambda n, s: F.least(F.lit(s), F.greatest(F.col(n), F.lit(1)))
    count = lambda n, s: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / edge(n, s)).cast("int")))
    rows = slices.select("volume_id", "d", "h", "w", F.floor(F.col("z") / edge("d", size[0])).cast("int").alias("bz")).distinct()
    rows = rows.withColumn("by", count("h", size[1])).withColumn("bx", count("w", size[2]))
    return rows.select("volume_id", "d", "h", "w", "bz", "by", "bx", F.lit(b"").alias("at"), F.lit(b"").alias("value"))


def on_blocks(df: DataFrame, dims: DataFrame, halo: tuple[Pair, Pair, Pair], f: Callable[[Block], pa.RecordBatch | None], schema: str, col: str = "value", size: tuple[int, int, int] = SIZE, border: str = "mirror", missing: float = 0.0, slices: bool = False) -> DataFrame:
    """The rows (schema) that f gives for each block of df (C, col), col a number or an array of one length.

    halo: voxels before and after the block by axis (z, y, x); border: mirror (needs as many before as after, or more), edge
    or missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(7)]
            for i in range(batch.num_rows):
                now = tuple(c[i] for c in cols)
                if now != key:
                    if key is not None:
                        out = f(_block(key, parts, size, halo, border, missing))
                        if out is not None:
                            yield out
                    key, parts = now, []
                parts.append((batch.column(7)[i].as_py(), batch.column(8)[i].as_py()))
        if key is not None:
            out = f(_block(key, parts, size, halo, border, missing))
            if out is not None:
                yield out

    packs = packed(df, dims, col, size, halo)
    if slices:
        packs = packs.union(_all_blocks(df, dims, size))
    keys = ["volume_id", "bz", "by", "bx"]
    return packs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


VOXEL = "volume_id string, z int, y int, x int"


def voxel_rows(b: Block, columns: dict[str, np.ndarray], keep: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (C, columns) of a block's own voxels: all, or those of a mask."""
    z, y, x = b.places()
    flat = {n: a.reshape(len(z), *a.shape[3:]) for n, a in columns.items()}
    if keep is not None:
        at = np.flatnonzero(keep.reshape(-1))
        z, y, x, flat = z[at], y[at], x[at], {n: a[at] for n, a in flat.items()}
    volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(z), np.int64)))
    arrays = []
    for a in flat.values():
        if a.ndim == 1:
            arrays.append(pa.array(a))
        else:
            offs = pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1])
            arrays.append(pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(a).reshape(-1))))
    return pa.RecordBatch.from_arrays([volume, pa.array(z), pa.array(y), pa.array(x), *arrays], [*C, *flat])


def filtered(df: DataFrame, dims: DataFrame, halo: tuple[Pair, Pair, Pair], f: Callable[[Block], dict[str, np.ndarray]], names: tuple[str, ...] = ("value",), size: tuple[int, int, int] = SIZE, border: str = "mirror") -> DataFrame:
    """(C, names) of the voxels of df: f gives an array of the block's own voxels for each name."""
    return on_blocks(df, dims, halo, lambda b: voxel_rows(b, f(b), b.inner(b.present)), VOXEL + "".join(f", {n} double" for n in names), size=size, border=border)


# ---- separable filters on dense arrays whose halo they use up


def slid(a: np.ndarray, axis: int, n: int, fn: np.ufunc) -> np.ndarray:
    """fn over n places in a row along an axis; the axis gets n - 1 shorter."""
    a = np.moveaxis(a, axis, 0)
    out, width = a, 1
    while 2 * width <= n:
        out = fn(out[:-width], out[width:])
        width *= 2
    if width < n:
        out = fn(out[: len(out) - (n - width)], out[n - width :])
    return np.moveaxis(out, 0, axis)


def summed(a: np.ndarray, axis: int, n: int) -> np.ndarray:
    """Sums of n places in a row; the axis gets n - 1 shorter."""
    if n == 1:
        return a
    a = np.moveaxis(a, axis, 0)
    out = a[: len(a) - n + 1].copy()
    for k in range(1, n):
        out += a[k : len(a) - n + 1 + k]
    return np.moveaxis(out, 0, axis)


def weighted(a: np.ndarray, axis: int, weights: list[float]) -> np.ndarray:
    """Weighted sums of places in a row, weights symmetric; the axis gets shorter by all but one."""
    a = np.moveaxis(a, axis, 0)
    r, n = len(weights) // 2, len(a) - len(weights) + 1
    out = weights[r] * a[r : r + n]
    for k in range(1, r + 1):
        out += weights[r + k] * (a[r - k : r - k + n] + a[r + k : r + k + n])
    return np.moveaxis(out, 0, axis)
