"""Tiled scoring with a user's function, and clustering of feature vectors.

A scorer maps a dict with `features` (n, ph, pw, k) to scores (n, ph, pw). Tiles are cut from blocks of voxels; overlaps
are averaged (or maximised) by one grouping over voxels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators.windows import gaussian_smooth
from ..sources.derived import C


#: Tiles given to the scorer at once.
TILES_PER_CALL = 32


def score_tiles(features: DataFrame, scorer: Callable, dims: DataFrame, patch: int = 160, stride: int = 120, thickness: int = 2, fuse: str = "avg", sigma: tuple | None = None, dedupe: bool = False, threshold: float = 0.5) -> DataFrame:
    """(C, value) of features (C, f): sliding tiles, overlaps fused, then smoothed if sigma is given.

    value: sigmoids of the tiles' scores, averaged (or 1 where any is above the threshold); null without a tile, 0 in the
    margin slices. Tiles start at every stride, clamped into the slice; a clamped origin may repeat, unless dedupe. An error
    where a slice is smaller than the patch. Slices must be dense.

    A task cuts the tiles that begin in a block from the block and what lies after it, and adds up their scores; only
    these sums meet those of other blocks.
    """
    if dims.where((F.col("h") < patch) | (F.col("w") < patch)).head(1):
        raise ValueError("a slice is smaller than the patch")
    edge = stride * max(1, round(2 * patch / stride))

    def starts(n: int, low: int, own: int) -> list[int]:
        at = [min(s, n - patch) for s in range(0, n, stride)]
        return [s - low for s in (dict.fromkeys(at) if dedupe else at) if low <= s < low + own]

    def f(b: blocks.Block) -> pa.RecordBatch:
        x = b.values if b.values.ndim == 4 else b.values[..., None]
        total, n = np.zeros(x.shape[:3]), np.zeros(x.shape[:3], np.int64)
        tiles = [(y, x) for y in starts(b.dims[1], b.origin[1], b.shape[1]) for x in starts(b.dims[2], b.origin[2], b.shape[2])]
        for k in range(b.shape[0]):
            if not thickness <= b.origin[0] + k < b.dims[0] - thickness:
                n[k, : b.shape[1], : b.shape[2]] = 1  # a margin slice: 0
                continue
            for i in range(0, len(tiles), TILES_PER_CALL):
                some = tiles[i : i + TILES_PER_CALL]
                out = np.asarray(scorer({"features": np.stack([x[k, p : p + patch, q : q + patch] for p, q in some])}), float)
                for (p, q), s in zip(some, 1 / (1 + np.exp(-out.reshape(len(some), patch, patch)))):
                    at = (k, slice(p, p + patch), slice(q, q + patch))
                    total[at] = total[at] + s if fuse == "avg" else np.maximum(total[at], s > threshold)
                    n[at] += 1
        given = n > 0
        given[:, : b.shape[1], : b.shape[2]] = True  # own voxels, with or without a tile
        at = np.flatnonzero(given.reshape(-1))
        z, y, x = (c[at] for c in b.places(inside=False))
        volume = pa.array([b.volume_id], pa.string()).take(pa.array(np.zeros(len(at), np.int64)))
        return pa.RecordBatch.from_arrays([volume, *map(pa.array, (z, y, x)), pa.array(total.reshape(-1)[at]), pa.array(n.reshape(-1)[at])], [*C, "total", "n"])

    sums = blocks.on_blocks(features, dims, ((0, 0), (0, patch - 1), (0, patch - 1)), f, blocks.VOXEL + ", total double, n long", "f", (1, edge, edge), "missing")
    n = F.sum("n")
    value = F.sum("total") / n if fuse == "avg" else F.max("total")
    out = sums.groupBy(*C).agg(F.when(n > 0, value).alias("value"))
    return gaussian_smooth(out.na.fill(0.0, ["value"]), sigma, dims) if sigma else out


def score_slices(features: DataFrame, scorer: Callable, dims: DataFrame, thickness: int = 2, sigma: tuple = (1, 3, 3)) -> DataFrame:
    """(C, value): whole slices scored one by one, 0 in the margin slices, then smoothed."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], ignore_index=True)
        h, w = int(f["y"].max()) + 1, int(f["x"].max()) + 1
        s = np.asarray(scorer({"features": np.stack(f["f"].to_numpy()).reshape(1, h, w, -1)}), float).reshape(-1)
        return f[[*C]].assign(value=1 / (1 + np.exp(-s)))

    out = features.select(*C, "f").groupBy("volume_id", "z").applyInPandas(run, "volume_id string, z int, y int, x int, value double")
    out = out.join(dims, "volume_id")
    inner = (F.col("z") >= thickness) & (F.col("z") < F.col("d") - thickness)
    return gaussian_smooth(out.select(*C, F.when(inner, F.col("value")).otherwise(0.0).alias("value")), sigma, dims)


def cluster_voxels(features: DataFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """(C, label): k-means clusters of feature vectors, numbered by their centres' first elements."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = features.select(*C, array_to_vector(F.col("f").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    order = np.argsort(np.argsort([c[0] for c in model.clusterCenters()])).tolist()
    rank = F.element_at(F.array(*[F.lit(int(r)) for r in order]), F.col("prediction") + 1)
    return model.transform(rows).select(*C, rank.alias("label"))


