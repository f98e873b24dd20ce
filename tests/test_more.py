"""Raw files, clusters, region tables and cubic resampling against direct computation."""

import numpy as np
from pyspark.sql import functions as F

from stratavox.operators import pixel as px
from stratavox.operators import regions as re_
from stratavox.plans import scoring
from stratavox.sources import volumes

from .test_volumes import VOXEL, dense, volume


def test_raw_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (3, 5, 4), dtype=np.uint8), rng.integers(0, 256, (3, 5, 4), dtype=np.uint8)
    for name, v in (("left.raw", a), ("right", b)):
        (tmp_path / name).write_bytes(v.tobytes())
    rows = volumes.read_raw_tiles(spark, str(tmp_path), (3, 5, 4))
    for name, v in (("left", a), ("right", b)):
        assert np.array_equal(dense(rows.where(F.col("volume_id") == name), v.shape), v)
    wide = rng.integers(0, 60_000, (2, 3, 3), dtype=np.uint16)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "w.raw").write_bytes(wide.tobytes())
    assert np.array_equal(dense(volumes.read_raw_tiles(spark, str(tmp_path / "deep"), (2, 3, 3), "uint16"), wide.shape), wide)


def test_clusters_are_numbered_by_their_centres(spark):
    rng = np.random.default_rng(2)
    kind = rng.integers(0, 3, (2, 9, 9))
    v = np.array([10.0, 50.0, 90.0])[kind] + rng.normal(0, 1, kind.shape)
    df, _ = volume(spark, v)
    out = scoring.cluster_voxels(df.select("volume_id", "z", "y", "x", F.array("value", F.lit(1.0)).alias("f")), 3)
    assert np.array_equal(dense(out, v.shape, "label"), kind)


def test_region_table_of_slices(spark):
    rng = np.random.default_rng(3)
    shapes = {1: [(y, x) for y in range(4) for x in range(9)], 2: [(y, x) for y in range(8) for x in range(8) if y in (0, 7) or x == 0], 3: [(int(a), int(b)) for a, b in {tuple(p) for p in rng.integers(0, 9, (50, 2))}], 4: [(0, 0), (0, 1)]}
    rows = [("v", 0, y, x + 20 * k, k) for k, cells in shapes.items() for y, x in cells]
    got = {r.label: r for r in re_.regionprops_2d(spark.createDataFrame(rows, VOXEL + ", label long"), 8).collect()}
    assert sorted(got) == [1, 2, 3]
    for k in got:
        y, x = (np.array(c, float) for c in zip(*shapes[k]))
        n, sides = len(y), (np.ptp(y) + 1, np.ptp(x) + 1)
        l2, l1 = np.linalg.eigvalsh(np.cov(np.stack([y, x]), bias=True))
        r = got[k]
        assert r["size"] == n and np.isclose(r.extent, n / (sides[0] * sides[1])) and np.isclose(r.bbox_aspect, max(sides) / min(sides))
        assert np.isclose(r.elongation, np.sqrt(l1 / l2)) and np.isclose(r.eccentricity, np.sqrt(1 - l2 / l1))
        assert np.isclose(r.solidity, 1.0) if k == 1 else 0 < r.solidity < 1


def natural_spline(y, at):
    """The natural cubic through y at 0, 1, 2 ...: second derivatives from one dense system."""
    n = len(y)
    m, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        m[i, i - 1 : i + 2], r[i] = (1, 4, 1), 6 * (y[i + 1] - 2 * y[i] + y[i - 1])
    s = np.linalg.solve(m, r)
    k = np.minimum(np.floor(at).astype(int), n - 2)
    t = at - k
    return (1 - t) * y[k] + t * y[k + 1] + ((1 - t) ** 3 - (1 - t)) * s[k] / 6 + (t**3 - t) * s[k + 1] / 6


def test_cubic_resampling_is_the_natural_spline(spark):
    v = np.random.default_rng(4).normal(0, 10, (7, 3, 2))
    df, _ = volume(spark, v)
    out = px.resample_z(df, 2.0)
    deep = out.agg(F.max("z")).first()[0] + 1
    got = dense(out, (deep, 3, 2))
    at = np.linspace(0, 6, deep)
    for y, x in np.ndindex(3, 2):
        assert np.allclose(got[:, y, x], natural_spline(v[:, y, x], at), atol=1e-8)
