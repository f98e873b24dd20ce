"""The registered queries over volumes derived from the tables, each with its SQL where SQL can express it.

Real numbers are rounded to six places on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import linear_index
from .operators import components as co
from .operators import features as fe
from .operators import matching as ma
from .operators import metrics as me
from .operators import morphology as mo
from .operators import pixel as px
from .operators import regions as re_
from .operators import sampling as sa
from .operators import windows as wi
from .plans import jobs, scoring
from .sources import derived, volumes
from .sources.derived import C
from .sources.store import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: SQL that spreads labels over large components step by step: for tests on the smallest tables only.
SMALL_SQL: dict[str, str] = {}


class Tables:
    """The derived tables of one call."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def vox(self) -> DataFrame:
        return derived.voxels(self.spark, self.sf_dir, sizes=self.dims)

    def kept(self) -> Tables:
        """Store the voxels first: for queries that pass over them again and again."""
        self.__dict__["vox"] = written(self.vox, "voxels")
        return self

    @cached_property
    def dims(self) -> DataFrame:
        return written(derived.dims(self.spark, self.sf_dir), "dims")

    @cached_property
    def gt(self) -> DataFrame:
        return derived.mask_above(self.vox, 128)

    @cached_property
    def seed(self) -> DataFrame:
        return self.vox.where("value >= 160").select(*C)

    @cached_property
    def negative(self) -> DataFrame:
        return self.vox.where("value < 8").select(*C)

    @cached_property
    def pred(self) -> DataFrame:
        return derived.prediction(self.vox)

    @cached_property
    def flat(self) -> DataFrame:
        return written(co.label_2d(self.seed, self.dims), "flat")

    @cached_property
    def solid(self) -> DataFrame:
        return written(co.label_3d(self.seed, self.dims, 6), "solid")

    def table(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("cell"), (F.col("user_id") % 10).cast("int").alias("trial"), (F.col("user_id") % 3).cast("int").alias("method"), (30 + 10 * (F.col("user_id") % 5)).cast("int").alias("ratio"), "value")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, floats: str = "", base: bool = True, small: bool = False):
    """Register a query; sql may use the derived tables and ends with a SELECT; floats are rounded in it. small: the SQL
    is too slow for whole tables and serves tests only."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(Tables(spark, sf_dir)))
        if sql:
            head, _, select = sql.rpartition(";")
            ctes = ", ".join(x for x in ((derived.sql() if base else ""), head.strip().strip(",")) if x)
            rest = f"* REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in floats.split())})" if floats else "*"
            (SMALL_SQL if small else ORACLE_SQL)[name] = f"WITH RECURSIVE {ctes} SELECT {rest} FROM ({select})" if ctes else f"SELECT {rest} FROM ({select})"
        return f

    return add


CC = "volume_id, z, y, x"
HASH = "((({0}) % 2147483648) * 2654435761 + {1}) % 4294967296"
PREDS = "preds AS (SELECT r.run, v.volume_id, v.z, v.y, v.x, (value + 7 * ((z * 31 + y * 17 + x * 13 + run) % 11)) / 330.0::DOUBLE AS area FROM voxels v, (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS run) r)"
PRED0 = "pred AS (SELECT volume_id, z, y, x, (value + 7 * ((z * 31 + y * 17 + x * 13) % 11)) / 330.0::DOUBLE AS area, (value + 5 * ((z * 31 + y * 17 + x * 13 + 3) % 11)) / 330.0::DOUBLE AS edge FROM voxels)"


def sql_win(name: str, src: str, axis: str, a: int, b: int, keep: str, exprs: str) -> str:
    others = ", ".join(c for c in C if c != axis)
    keep = f", {keep}" if keep else ""
    return f"{name} AS (SELECT {CC}{keep}, {exprs} FROM {src} WINDOW w AS (PARTITION BY {others} ORDER BY {axis} RANGE BETWEEN {a} PRECEDING AND {b} FOLLOWING))"


def sql_sum(name: str, src: str, axis: str, a: int, b: int, cols: list[str]) -> str:
    """Window sums with mirrored borders."""
    n = {"z": "d", "y": "h", "x": "w"}[axis]
    cs = ", ".join(cols)
    at = lambda e: CC.replace(f" {axis}", f" {e} AS {axis}") if axis != "volume_id" else CC
    other = ", ".join(c for c in C if c != axis)
    mir = f"SELECT {at(axis)}, n, {cs} FROM s UNION ALL SELECT {at('-1 - ' + axis)}, n, {cs} FROM s WHERE {axis} < {a} UNION ALL SELECT {at('2 * n - 1 - ' + axis)}, n, {cs} FROM s WHERE {axis} >= n - {b}"
    sums = ", ".join(f"sum({c}) OVER w AS {c}" for c in cols)
    return f"{name} AS (SELECT {CC}, {cs} FROM (WITH s AS (SELECT t.*, dims.{n} AS n FROM {src} t JOIN dims USING (volume_id)) SELECT {CC}, n, {sums} FROM ({mir}) WINDOW w AS (PARTITION BY {other} ORDER BY {axis} RANGE BETWEEN {a} PRECEDING AND {b} FOLLOWING)) WHERE {axis} >= 0 AND {axis} < n)"


def sql_labels(name: str, mask: str, steps: list[tuple[int, int, int]], extra: str = "") -> str:
    """Component labels by spreading the smallest index; extra columns must agree."""
    unions = " UNION ALL ".join(f"SELECT a.volume_id, a.id AS a, b.id AS b FROM {name}_n a JOIN {name}_n b ON a.volume_id = b.volume_id AND b.z = a.z + {dz} AND b.y = a.y + {dy} AND b.x = a.x + {dx}{f' AND a.{extra} = b.{extra}' if extra else ''}" for dz, dy, dx in steps)
    more = f", {extra}" if extra else ""
    return f"""{name}_n AS MATERIALIZED (SELECT m.volume_id, m.z, m.y, m.x{', m.' + extra if extra else ''}, (m.z::BIGINT * h + m.y) * w + m.x AS id FROM {mask} m JOIN dims USING (volume_id)),
{name}_h AS ({unions}), {name}_e AS MATERIALIZED (SELECT * FROM {name}_h UNION ALL SELECT volume_id, b, a FROM {name}_h),
{name}_c(volume_id, id, label) USING KEY (volume_id, id) AS (SELECT volume_id, id, id FROM {name}_n UNION (SELECT e.volume_id, e.b, min(c.label) FROM {name}_c c JOIN {name}_e e ON e.volume_id = c.volume_id AND e.a = c.id JOIN recurring.{name}_c o ON o.volume_id = e.volume_id AND o.id = e.b WHERE c.label < o.label GROUP BY e.volume_id, e.b)),
{name} AS MATERIALIZED (SELECT n.volume_id, n.z, n.y, n.x{more.replace(', ', ', n.') if extra else ''}, c.label FROM {name}_n n JOIN {name}_c c USING (volume_id, id))"""


FLAT4 = [(0, 0, 1), (0, 1, 0)]
SIX = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
LAB2 = sql_labels("lab", "seed", FLAT4)
LAB3 = sql_labels("lab", "seed", SIX)


def sql_dilate(name: str, src: str, sy: int, sx: int | None = None, sz: int = 1) -> str:
    sx = sy if sx is None else sx
    rng = lambda n: f"range(-{n // 2}, {(n - 1) // 2 + 1})"
    return f"{name} AS MATERIALIZED (SELECT DISTINCT m.volume_id, m.z + oz AS z, m.y + oy AS y, m.x + ox AS x FROM {src} m JOIN dims USING (volume_id), (SELECT CAST(unnest({rng(sz)}) AS INTEGER) AS oz), (SELECT CAST(unnest({rng(sy)}) AS INTEGER) AS oy), (SELECT CAST(unnest({rng(sx)}) AS INTEGER) AS ox) WHERE m.z + oz BETWEEN 0 AND d - 1 AND m.y + oy BETWEEN 0 AND h - 1 AND m.x + ox BETWEEN 0 AND w - 1)"


def sql_erode(name: str, src: str, sy: int, sx: int | None = None, sz: int = 1) -> str:
    sx = sy if sx is None else sx
    rng = lambda n: f"range(-{(n - 1) // 2}, {n // 2 + 1})"
    return f"{name} AS MATERIALIZED (SELECT volume_id, z, y, x FROM (SELECT m.volume_id, m.z + oz AS z, m.y + oy AS y, m.x + ox AS x FROM {src} m, (SELECT CAST(unnest({rng(sz)}) AS INTEGER) AS oz), (SELECT CAST(unnest({rng(sy)}) AS INTEGER) AS oy), (SELECT CAST(unnest({rng(sx)}) AS INTEGER) AS ox)) GROUP BY ALL HAVING count(*) = {sy * sx * sz})"


EV = "ev AS (SELECT event_type AS cell, CAST(user_id % 10 AS INTEGER) AS trial, CAST(user_id % 3 AS INTEGER) AS method, CAST(30 + 10 * (user_id % 5) AS INTEGER) AS ratio, value FROM events)"


# ---- sources and sinks


@query("s1_read_voxels", f"; SELECT {CC}, value FROM voxels", "value")
def _(t):
    path = new_path(t.spark, "s1")
    t.vox.write.parquet(path)
    return volumes.read_voxels(t.spark, path)


@query("s2_read_layer", f"; SELECT {CC}, value FROM voxels WHERE value > 0", "value")
def _(t):
    root = new_path(t.spark, "layers")
    raw = t.vox.select("*", F.lit("raw").alias("layer"), F.lit("s3").alias("resolution"))
    volumes.write_layer(raw.where("value > 0").unionByName(raw.select(*C, "value", F.lit("raw").alias("layer"), F.lit("s4").alias("resolution"))), root)
    return volumes.read_layer(t.spark, root, "raw", "s3").select(*C, "value")


@query("s3_transpose_axes", "; SELECT volume_id, y AS z, x AS y, z AS x, value FROM voxels", "value")
def _(t):
    return volumes.transpose_axes(t.vox, (1, 2, 0))


@query("s4_ensure_features", f"; SELECT a.volume_id, a.z, a.y, a.x, avg(b.value) AS mean FROM voxels a JOIN dims USING (volume_id) JOIN voxels b ON a.volume_id = b.volume_id AND a.y = b.y AND a.x = b.x AND b.z BETWEEN a.z - 1 AND a.z + 1 WHERE a.z BETWEEN 1 AND d - 2 GROUP BY 1, 2, 3, 4", "mean")
def _(t):
    path = new_path(t.spark, "store")
    slab = lambda rows: fe.z_aggregate(rows, 1).select(*C, F.col("value").alias("mean"))
    volumes.ensure_features(t.spark, t.vox.where("z < 2"), path, slab, 1)  # the first slices only; then the rest
    return volumes.ensure_features(t.spark, t.vox, path, slab, 1).select(*C, "mean")


@query("s6_write_labels", f"; SELECT {CC}, CAST(k AS INTEGER) AS iteration FROM voxels, (SELECT unnest([0, 1]) AS k) WHERE value > CASE k WHEN 0 THEN 200 ELSE 180 END")
def _(t):
    path = new_path(t.spark, "labels")
    for k, cut in ((0, 128), (1, 180), (0, 200)):  # a round that is written again replaces itself alone
        volumes.write_labels(derived.mask_above(t.vox, cut), path, k)
    return t.spark.read.parquet(path).select(*C, "iteration")


@query("s10_write_regions_csv", f"{LAB2}, b AS (SELECT volume_id, label, count(*) AS size, min(y) AS y0, max(x) + 1 AS x1 FROM lab GROUP BY 1, 2); SELECT * FROM b")
def _(t):
    path = new_path(t.spark, "csv")
    volumes.write_regions_csv(re_.region_basics(t.flat).select("volume_id", "label", "size", "y0", "x1"), path)
    return t.spark.read.option("header", True).schema("volume_id string, label long, size long, y0 int, x1 int").csv(path)


@query("s11_append_results", f"{EV}; SELECT cell, trial, count(*) AS n, sum(CAST(floor(value) AS BIGINT)) AS total FROM ev GROUP BY 1, 2", base=False)
def _(t):
    path, keys = new_path(t.spark, "results"), ["cell", "trial"]
    runs = t.events.select(*keys).distinct()
    evaluate = lambda pending: t.events.join(pending, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    volumes.append_results(t.spark, runs.where("trial < 4"), path, keys, evaluate)  # stopped early, then started again
    return volumes.append_results(t.spark, runs, path, keys, evaluate)


@query("s5_resolve_negative", """; SELECT volume_id AS request_id, z, y, x FROM voxels WHERE (volume_id = 'A' AND value < 8) OR (volume_id = 'N' AND value < 16)""")
def _(t):
    req = t.dims.select(F.col("volume_id").alias("request_id"), F.col("volume_id").alias("mask_id"), F.col("volume_id").alias("raw_id"))
    f = lambda df: df.select(F.col("volume_id").alias("file_id"), "z", "y", "x")
    return volumes.resolve_negative(req, f(t.vox.where("value < 8 and volume_id = 'A'")), f(t.vox.where("value < 16 and volume_id <> 'R'")))


@query("s7_compose_rgb", f"""{PRED0}, u AS (SELECT p.volume_id, p.z, p.y, p.x, v.value AS a, p.area AS b, p.edge AS c FROM pred p JOIN voxels v USING ({CC})), e AS (SELECT volume_id, min(a) al, max(a) ah, min(b) bl, max(b) bh, min(c) cl, max(c) ch FROM u GROUP BY 1);
SELECT {CC}, CAST(floor((a - al) / (ah - al + 1e-8) * 255) AS INTEGER) AS r, CAST(floor((b - bl) / (bh - bl + 1e-8) * 255) AS INTEGER) AS g, CAST(floor((c - cl) / (ch - cl + 1e-8) * 255) AS INTEGER) AS b FROM u JOIN e USING (volume_id)""")
def _(t):
    return volumes.compose_rgb(t.pred.join(t.vox, C), "value", "area", "edge")


@query("s8_compose_channels", f"""{PRED0}, u AS (SELECT {CC}, value / 254.0::DOUBLE AS value, area, edge FROM pred JOIN voxels USING ({CC})), b AS (SELECT {CC}, CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, value * 255))) AS INTEGER) AS value, CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, area * 255))) AS INTEGER) AS area, CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, edge * 255))) AS INTEGER) AS edge FROM u);
SELECT {CC}, 'value' AS channel, value FROM b UNION ALL SELECT {CC}, 'area', area FROM b UNION ALL SELECT {CC}, 'edge', edge FROM b""")
def _(t):
    return volumes.compose_channels(t.pred.join(t.vox, C).withColumn("value", F.col("value") / 254.0), ["value", "area", "edge"])


@query("s9_overlay_classes", f"""{PRED0}; SELECT {CC}, CASE WHEN edge > 0.5 THEN 0 WHEN area > 0.5 THEN 255 ELSE CAST(floor(value) AS INTEGER) END AS r, CASE WHEN edge > 0.5 THEN 200 WHEN area > 0.5 THEN 40 ELSE CAST(floor(value) AS INTEGER) END AS g, CASE WHEN edge > 0.5 THEN 90 WHEN area > 0.5 THEN 10 ELSE CAST(floor(value) AS INTEGER) END AS b FROM pred JOIN voxels USING ({CC})""")
def _(t):
    t.kept()
    preds = t.pred.unpivot(C, ["area", "edge"], "class", "p")
    colors = t.spark.createDataFrame([("area", 0, 255, 40, 10), ("edge", 1, 0, 200, 90)], "class string, place int, r int, g int, b int")
    return volumes.overlay_classes(t.vox, preds, colors)




@query("s11_pending_runs", f"""{EV}; SELECT c.cell, t.trial FROM (SELECT DISTINCT cell FROM ev) c, (SELECT DISTINCT trial FROM ev) t WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.cell = c.cell AND ev.trial = t.trial AND ev.value > 200)""", base=False)
def _(t):
    expected = t.events.select("cell").distinct().crossJoin(t.events.select("trial").distinct())
    return volumes.pending_runs(expected, t.events.where("value > 200"), ["cell", "trial"])


@query("s12_available_runs", f"""{EV}, k AS (SELECT DISTINCT cell, trial FROM ev); SELECT k.cell, k.trial, k.cell || k.trial IN (SELECT cell || trial FROM ev WHERE value > 220 AND method = 1) AS has_baseline FROM k WHERE cell || trial IN (SELECT cell || trial FROM ev WHERE value > 190)""", base=False)
def _(t):
    return volumes.available_runs(t.events.select("cell", "trial").distinct(), t.events.where("value > 190"), t.events.where("value > 220 and method = 1"), ["cell", "trial"])


@query("s13_parse_run_name", """; SELECT event_id, event_type AS cell, 'mito' AS organelle, CAST(30 + 10 * (user_id % 5) AS INTEGER) AS ratio, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 10 AS INTEGER) END AS trial FROM events""", base=False)
def _(t):
    e = t.table("events")
    name = F.concat(F.lit("label_"), "event_type", F.lit("_mito_"), (30 + 10 * (F.col("user_id") % 5)).cast("string"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("_"), (F.col("user_id") % 10).cast("string"))).otherwise(""))
    return e.select("event_id", *volumes.run_keys(name))


@query("p16_dense_sparse", f"; SELECT {CC}, CAST(value > 128 AS INTEGER) AS value FROM voxels")
def _(t):
    return volumes.to_dense(t.gt, t.dims)


@query("p16_blocks_round_trip", f"; SELECT {CC}, value FROM voxels", "value")
def _(t):
    return volumes.to_voxels(volumes.to_blocks(t.vox, (1, 16, 16)))


# ---- pixels


@query("p1_binarize", f"; SELECT {CC} FROM voxels WHERE value > 0")
def _(t):
    return px.binarize(t.vox)


@query("p2_minmax", f"; SELECT {CC}, (value - min(value) OVER (PARTITION BY volume_id)) / (max(value) OVER (PARTITION BY volume_id) - min(value) OVER (PARTITION BY volume_id)) AS value FROM voxels", "value")
def _(t):
    return px.minmax_normalize(t.vox)


@query("p3_percentile_threshold", f"{PREDS}, cut AS (SELECT run, volume_id, quantile_cont(area, 0.9) AS c FROM preds GROUP BY 1, 2); SELECT run, {CC} FROM preds JOIN cut USING (run, volume_id) WHERE area >= greatest(c, 0.5)")
def _(t):
    t.kept()
    return px.percentile_threshold(derived.predictions(t.vox), 0.9, 0.5, ("run", "volume_id"), "area").select("run", *C)


@query("p4_fixed_threshold", f"; SELECT {CC} FROM voxels WHERE value > 127.5")
def _(t):
    return px.fixed_threshold(t.vox, 127.5)


@query("p5_percentile_binarize", f"; SELECT {CC}, CAST(value <= quantile_cont(value, 0.2) OVER (PARTITION BY volume_id, z) AS INTEGER) AS value FROM voxels")
def _(t):
    t.kept()
    return px.percentile_binarize(t.vox, 0.2, below=True)


@query("p6_clip_normalize", f"q AS (SELECT volume_id, z, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM voxels GROUP BY 1, 2); SELECT {CC}, coalesce((greatest(lo, least(hi, value)) - lo) / nullif(hi - lo, 0), 0) AS value FROM voxels JOIN q USING (volume_id, z)", "value")
def _(t):
    t.kept()
    return px.clip_normalize(t.vox)


@query("p7_zscore", f"q AS (SELECT volume_id, avg(value) AS m, stddev_pop(value) AS s FROM voxels GROUP BY 1); SELECT {CC}, (value - m) / s AS value FROM voxels JOIN q USING (volume_id)", "value")
def _(t):
    return px.zscore(t.vox)


@query("p8_pad_unpad", f"p AS (SELECT v.volume_id, zs.z, CAST(yy AS INTEGER) AS y, CAST(xx AS INTEGER) AS x FROM vols v, zs, (SELECT unnest(range(0, 36)) AS yy), (SELECT unnest(range(0, 36)) AS xx)); SELECT p.*, coalesce(v.value, 0) AS value FROM p LEFT JOIN voxels v ON v.volume_id = p.volume_id AND v.z = p.z AND v.y = p.y - 2 AND v.x = p.x - 2", "value")
def _(t):
    return px.pad_to_multiple(t.vox, t.dims, 12)[0]


@query("p8_unpad", f"; SELECT {CC}, value FROM voxels", "value")
def _(t):
    return px.unpad(*px.pad_to_multiple(t.vox, t.dims, 12))


@query("p9_downsample_mean", "; SELECT volume_id, z, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, sum(value) / 9 AS value FROM voxels GROUP BY 1, 2, 3, 4", "value")
def _(t):
    return px.downsample_mean(t.vox, 3)


@query("p10_downsample_max", "; SELECT DISTINCT volume_id, z, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x FROM seed")
def _(t):
    return px.downsample_max(t.seed, 3)


@query("p11_labelled_slices", "; SELECT volume_id, z, count(*) AS n FROM seed GROUP BY 1, 2")
def _(t):
    return px.labelled_slices(t.seed)


@query("p12_crop", "; SELECT volume_id, z - 1 AS z, y - 4 AS y, x - 8 AS x, value FROM voxels WHERE z >= 1 AND z < 3 AND y >= 4 AND y < 20 AND x >= 8 AND x < 30", "value")
def _(t):
    return px.crop(t.vox, (1, 3), (4, 20), (8, 30))


@query("p12_apply_mask", f"; SELECT {CC}, CASE WHEN value > 128 THEN value ELSE 0 END AS value FROM voxels", "value")
def _(t):
    return px.apply_mask(t.vox, t.gt)


BINS = "bins AS (SELECT volume_id, z, y, x, CAST(least(3, greatest(1, ceil((value - lo) * 3 / (hi - lo)))) AS INTEGER) AS bin FROM voxels JOIN (SELECT volume_id, min(value) AS lo, max(value) AS hi FROM voxels GROUP BY 1) USING (volume_id) WHERE value > lo)"


@query("p13_value_bins", f"{BINS}; SELECT {CC}, bin FROM bins")
def _(t):
    return px.value_bins(t.vox, 3)


@query("p14_resample_z_linear", f"n AS (SELECT {CC}, value, lead(value) OVER (PARTITION BY volume_id, y, x ORDER BY z) AS nx FROM voxels); SELECT volume_id, CAST(z * 5 + k AS INTEGER) AS z, y, x, CASE WHEN k = 0 THEN value ELSE value + (nx - value) * k / 5 END AS value FROM n, (SELECT unnest(range(0, 5)) AS k) WHERE k = 0 OR nx IS NOT NULL", "value")
def _(t):
    return px.resample_z_linear(t.vox, 5)


@query("p14_resample_z_cubic")
def _(t):
    return px.resample_z(t.vox, 2.0, dims=t.dims)


PATCHES = "patches AS (SELECT volume_id || ':' || z AS patch_id, volume_id, z, CAST((z * 3) % 20 AS INTEGER) AS y0, CAST((z * 5) % 20 AS INTEGER) AS x0 FROM vols, zs)"


def _patches(t):
    return t.vox.select("volume_id", "z").distinct().select(F.concat_ws(":", "volume_id", F.col("z").cast("string")).alias("patch_id"), "volume_id", "z", (F.col("z") * 3 % 20).alias("y0"), (F.col("z") * 5 % 20).alias("x0"))


@query("p15_augment_patches", f"""{PATCHES}, e AS (SELECT patch_id, p.z, v.y - y0 AS py, v.x - x0 AS px, value, CAST((p.z * 2654435761 + 9) % 4294967296 % 8 AS INTEGER) AS c FROM patches p JOIN voxels v ON v.volume_id = p.volume_id AND v.z = p.z AND v.y BETWEEN y0 AND y0 + 11 AND v.x BETWEEN x0 AND x0 + 11),
f AS (SELECT patch_id, c, value, CASE WHEN c & 1 = 1 THEN 11 - py ELSE py END AS a, CASE WHEN c & 2 = 2 THEN 11 - px ELSE px END AS b FROM e); SELECT patch_id, CASE WHEN c & 4 = 4 THEN b ELSE a END AS py, CASE WHEN c & 4 = 4 THEN a ELSE b END AS px, value FROM f""", "value")
def _(t):
    p = _patches(t)
    rows = sa.extract_patches(p, t.vox, 12, 12).drop("dz").join(p.select("patch_id", F.col("z").cast("long").alias("k")), "patch_id")
    return px.augment_patches(rows, 12, 12, px.seeded_choice("k", 9)).select("patch_id", "py", "px", "value")


# ---- windows


def _n1(size: tuple[int, int, int]) -> str:
    out, prev = [f"w0 AS (SELECT {CC}, value, value AS lo, value AS hi FROM voxels)"], "w0"
    for k, (a, n) in enumerate(zip("zyx", size)):
        if n > 1:
            out.append(sql_win(f"w{k + 1}", prev, a, n // 2, n - 1 - n // 2, "value", "min(lo) OVER w AS lo, max(hi) OVER w AS hi"))
            prev = f"w{k + 1}"
    return ", ".join(out) + f"; SELECT {CC}, %s AS value FROM {prev}"


@query("n1_local_contrast", _n1((3, 20, 20)) % "(value - lo) / (hi - lo + 1e-5)", "value")
def _(t):
    return wi.local_contrast_normalize(t.vox, t.dims)


@query("n2_local_normalize_2d", _n1((1, 11, 11)) % "greatest(0, least(1, (value - lo) / (hi - lo + 1e-6)))", "value")
def _(t):
    return wi.local_normalize_2d(t.vox, t.dims, 6)


def _moments(size: tuple[int, int, int]) -> str:
    out, prev = [f"m0 AS (SELECT {CC}, value AS s, value * value AS s2 FROM voxels)"], "m0"
    for k, (a, n) in enumerate(zip("zyx", size)):
        if n > 1:
            out.append(sql_sum(f"m{k + 1}", prev, a, n // 2, n - 1 - n // 2, ["s", "s2"]))
            prev = f"m{k + 1}"
    n = size[0] * size[1] * size[2]
    return ", ".join(out) + f", lv AS (SELECT {CC}, greatest(0, s2 / {n} - s / {n} * (s / {n})) AS value FROM {prev})"


@query("n3_local_variance", _moments((1, 20, 20)) + f"; SELECT {CC}, value FROM lv", "value")
def _(t):
    return wi.local_variance(t.vox, (1, 20, 20), t.dims)


_N4 = [f"a0 AS (SELECT {CC}, value AS s FROM voxels)", f"b0 AS (SELECT {CC}, value * value AS q FROM voxels)"]
_N4 += [sql_sum(f"a{k + 1}", f"a{k}", a, 1, 1, ["s"]) for k, a in enumerate("zyx")]
_N4 += [sql_sum(f"b{k + 1}", f"b{k}", a, *((1, 1) if a == "x" else (3, 2)), ["q"]) for k, a in enumerate("zyx")]


@query("n4_local_standardize", ", ".join(_N4) + f"; SELECT {CC}, (value - s / 27) / (sqrt(greatest(0, q / 108 - s / 27 * (s / 27))) + 1e-2) AS value FROM voxels JOIN a3 USING ({CC}) JOIN b3 USING ({CC})", "value")
def _(t):
    return wi.local_standardize(t.vox, 3, t.dims)


_N5 = [PRED0, f"e0 AS (SELECT {CC}, edge AS s, edge * edge AS q FROM pred)", *(sql_sum(f"e{k + 1}", f"e{k}", a, 2, 2, ["s", "q"]) for k, a in enumerate("zyx"))]


@query("n5_enhance_by_variance", ", ".join(_N5) + f", rl AS MATERIALIZED (SELECT {CC}, (q / 125 - s / 125 * (s / 125)) / (q / 125 + 1e-6) AS rel FROM e3), en AS (SELECT volume_id, min(rel) AS lo, max(rel) AS hi FROM rl GROUP BY 1); SELECT {CC}, edge * (1 - (rel - lo) / (hi - lo + 1e-8)) AS value, 1 - (rel - lo) / (hi - lo + 1e-8) AS weight FROM pred JOIN rl USING ({CC}) JOIN en USING (volume_id)", "value weight")
def _(t):
    return wi.enhance_by_variance(t.pred.select(*C, F.col("edge").alias("value")), 5, t.dims)


@query("n6_mode_filter", ", ".join([f"c0 AS (SELECT {CC}, CAST(floor(value / 86) = 0 AS INTEGER) AS n0, CAST(floor(value / 86) = 1 AS INTEGER) AS n1, CAST(floor(value / 86) = 2 AS INTEGER) AS n2 FROM voxels)", sql_win("c1", "c0", "y", 2, 2, "", "sum(n0) OVER w AS n0, sum(n1) OVER w AS n1, sum(n2) OVER w AS n2"), sql_win("c2", "c1", "x", 2, 2, "", "sum(n0) OVER w AS n0, sum(n1) OVER w AS n1, sum(n2) OVER w AS n2")]) + f"; SELECT {CC}, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS label FROM c2")
def _(t):
    return wi.mode_filter(t.vox.select(*C, F.floor(F.col("value") / 86).cast("int").alias("label")), [0, 1, 2], 3)


@query("n7_dilate", sql_dilate("o", "seed", 3, 4, 3) + f"; SELECT {CC} FROM o")
def _(t):
    return mo.dilate(t.seed, (3, 3, 4), t.dims)


@query("n8_erode", sql_erode("o", "gt", 3, 2, 3) + f"; SELECT {CC} FROM o")
def _(t):
    return mo.erode(t.gt, (3, 3, 2))


@query("n9_opening", sql_erode("a", "gt", 3) + ", " + sql_dilate("o", "a", 3) + f"; SELECT {CC} FROM o")
def _(t):
    return mo.opening(t.gt, (1, 3, 3), t.dims)


@query("n9_closing", sql_dilate("a", "seed", 3) + ", " + sql_erode("o", "a", 3) + f"; SELECT {CC} FROM o")
def _(t):
    return mo.closing(t.seed, (1, 3, 3), t.dims)


@query("n10_dilate_diamond", "o AS (SELECT CAST(unnest(range(-2, 3)) AS INTEGER) AS o); SELECT DISTINCT volume_id, z + a.o AS z, y + b.o AS y, x + c.o AS x FROM seed JOIN dims USING (volume_id), o a, o b, o c WHERE abs(a.o) + abs(b.o) + abs(c.o) <= 2 AND z + a.o BETWEEN 0 AND d - 1 AND y + b.o BETWEEN 0 AND h - 1 AND x + c.o BETWEEN 0 AND w - 1")
def _(t):
    return mo.dilate_diamond(t.seed, 2, t.dims)


EDGE = sql_dilate("di", "seed", 3) + ", " + sql_erode("er", "seed", 3) + f", edge AS ((SELECT {CC} FROM di EXCEPT SELECT {CC} FROM er) UNION (SELECT {CC} FROM er EXCEPT SELECT {CC} FROM di))"


@query("n11_edge_mask", EDGE + f"; SELECT {CC} FROM edge")
def _(t):
    return mo.edge_mask(t.seed, 1, t.dims)


RINGS = sql_dilate("d1", "seed", 3) + ", " + sql_dilate("d2", "seed", 7) + f""", er2 AS (SELECT {CC} FROM (SELECT a.volume_id, a.z, a.y, a.x, count(*) AS n, any_value((least(a.y + 1, h - 1) - greatest(a.y - 1, 0) + 1) * (least(a.x + 1, w - 1) - greatest(a.x - 1, 0) + 1)) AS need FROM seed a JOIN dims USING (volume_id) JOIN seed b ON a.volume_id = b.volume_id AND a.z = b.z AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3, 4) WHERE n = need),
rings AS (SELECT {CC}, 'eroded' AS ring FROM er2 UNION ALL SELECT {CC}, 'edge' FROM (SELECT {CC} FROM seed EXCEPT SELECT {CC} FROM er2) UNION ALL SELECT {CC}, 'inner' FROM (SELECT {CC} FROM d1 EXCEPT SELECT {CC} FROM seed) UNION ALL SELECT {CC}, 'outer' FROM (SELECT {CC} FROM d2 EXCEPT SELECT {CC} FROM d1))"""


@query("n12_dilated_rings", RINGS + f"; SELECT {CC}, ring FROM rings")
def _(t):
    return mo.dilated_rings(t.seed, t.dims, 1, 2)


def _gauss_sql(sigma: float) -> str:
    w = wi.gaussian_weights(sigma)
    r = len(w) // 2
    table = ", ".join(f"({k - r}, {v!r}::DOUBLE)" for k, v in enumerate(w))
    return f"g AS (SELECT * FROM (VALUES {table}) t(k, w)), rd AS (SELECT v.volume_id, v.z, v.y, v.x, g.w AS wt, ((v.x + g.k) % 64 + 64) % 64 AS m FROM voxels v, g); SELECT rd.volume_id, rd.z, rd.y, rd.x, sum(wt * value) AS value FROM rd JOIN voxels v ON v.volume_id = rd.volume_id AND v.z = rd.z AND v.y = rd.y AND v.x = CASE WHEN m < 32 THEN m ELSE 63 - m END GROUP BY 1, 2, 3, 4"


@query("n13_gaussian_axis", _gauss_sql(3.0), "value")
def _(t):
    return wi.gaussian_axis(t.vox, "x", 3.0, t.dims)


def sql_gauss(name: str, src: str, sigma: tuple[float, float, float]) -> str:
    """Smoothing by (z, y, x): weights by their formula, positions mirrored as often as needed."""
    out, prev = [], src
    for axis, s in zip("zyx", sigma):
        if s > 0:
            r, n, now = int(4 * s + 0.5), {"z": "d", "y": "h", "x": "w"}[axis], f"{name}{axis}"
            same = " AND ".join(f"b.{c} = a.{c}" for c in C if c != axis)
            out.append(f"{now}w AS (SELECT k, e / sum(e) OVER () AS wt FROM (SELECT k, exp(-0.5 * k * k / ({s!r}::DOUBLE * {s!r})) AS e FROM (SELECT CAST(unnest(range({-r}, {r + 1})) AS INTEGER) AS k)))")
            out.append(f"{now} AS MATERIALIZED (SELECT a.volume_id, a.z, a.y, a.x, sum(wt * b.value) AS value FROM (SELECT {CC}, wt, {n} AS n, (({axis} + k) % (2 * {n}) + 2 * {n}) % (2 * {n}) AS m FROM {prev} JOIN dims USING (volume_id), {now}w) a JOIN {prev} b ON {same} AND b.{axis} = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY ALL)")
            prev = now
    return ", ".join([*out, f"{name} AS (SELECT * FROM {prev})"])


@query("n13_gaussian_smooth", sql_gauss("sm", "voxels", (1, 3, 3)) + f"; SELECT {CC}, value FROM sm", "value")
def _(t):
    return wi.gaussian_smooth(t.vox, (1, 3, 3), t.dims)


@query("n14_smooth_and_threshold", sql_gauss("sm", "voxels", (0, 1, 1)) + f"; SELECT {CC} FROM sm WHERE value > 128")
def _(t):
    return wi.smooth_and_threshold(t.vox, (0, 1, 1), 128, t.dims)


@query("n15_dog_energy", sql_gauss("sa", "voxels", (0, 1, 1)) + ", " + sql_gauss("sb", "voxels", (0, 2, 2)) + f", dg AS (SELECT {CC}, abs(sa.value - sb.value) AS v FROM sa JOIN sb USING ({CC})); SELECT {CC}, v / avg(v) OVER (PARTITION BY volume_id) AS value FROM dg", "value")
def _(t):
    return wi.dog_energy(t.vox, 1, 2, t.dims)


@query("n15_log_energy", sql_gauss("sm", "voxels", (0, 1.5, 1.5)) + f", lp AS (SELECT {CC}, abs(coalesce(lag(value) OVER wy, value) + coalesce(lead(value) OVER wy, value) + coalesce(lag(value) OVER wx, value) + coalesce(lead(value) OVER wx, value) - 4 * value) AS v FROM sm WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)); SELECT {CC}, v / avg(v) OVER (PARTITION BY volume_id) AS value FROM lp", "value")
def _(t):
    return wi.log_energy(t.vox, 1.5, t.dims)


@query("n16_gradient_sobel", f"n AS (SELECT {CC}, coalesce(lag(value) OVER wx, value) + 2 * value + coalesce(lead(value) OVER wx, value) AS sx, coalesce(lag(value) OVER wy, value) + 2 * value + coalesce(lead(value) OVER wy, value) AS sy FROM voxels WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)), g AS (SELECT {CC}, coalesce(lead(sx) OVER wy, sx) - coalesce(lag(sx) OVER wy, sx) AS gy, coalesce(lead(sy) OVER wx, sy) - coalesce(lag(sy) OVER wx, sy) AS gx FROM n WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)); SELECT {CC}, sqrt(gy * gy + gx * gx) AS value FROM g", "value")
def _(t):
    return wi.gradient_magnitude(t.vox, "sobel")


@query("n16_gradient_central", f"g AS (SELECT {CC}, (coalesce(lead(value) OVER wy, value) - coalesce(lag(value) OVER wy, value)) / CASE WHEN y IN (0, 31) THEN 1 ELSE 2 END AS gy, (coalesce(lead(value) OVER wx, value) - coalesce(lag(value) OVER wx, value)) / CASE WHEN x IN (0, 31) THEN 1 ELSE 2 END AS gx FROM voxels WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)); SELECT {CC}, sqrt(gy * gy + gx * gx) AS value FROM g", "value")
def _(t):
    return wi.gradient_magnitude(t.vox)


@query("n17_distance_map", f"far AS (SELECT {CC} FROM voxels WHERE value >= 252); SELECT v.volume_id, v.z, v.y, v.x, sqrt(min((v.z - f.z) * (v.z - f.z) + (v.y - f.y) * (v.y - f.y) + (v.x - f.x) * (v.x - f.x))) AS value FROM voxels v LEFT JOIN far f ON f.volume_id = v.volume_id GROUP BY 1, 2, 3, 4", "value")
def _(t):
    return fe.distance_map(t.vox.where("value >= 252"), t.dims)


@query("n17_distance_weight", f"far AS (SELECT {CC} FROM voxels WHERE value >= 252), dm AS (SELECT v.volume_id, v.z, v.y, v.x, sqrt(min((v.z - f.z) * (v.z - f.z) + (v.y - f.y) * (v.y - f.y) + (v.x - f.x) * (v.x - f.x))) AS value FROM voxels v LEFT JOIN far f ON f.volume_id = v.volume_id GROUP BY 1, 2, 3, 4); SELECT {CC}, 0.1::DOUBLE * greatest(0::DOUBLE, 1 / (1 + exp(-(coalesce(value, 1e9) - 6) / 1)) - 0.01::DOUBLE) AS value FROM dm", "value")
def _(t):
    return fe.distance_weight(fe.distance_map(t.vox.where("value >= 252"), t.dims), 6.0)


@query("n18_feature_bank")
def _(t):
    return fe.feature_bank(t.vox, t.dims, 1).select(*C, F.transform("f", lambda v: F.round(v.cast("double"), 3)).alias("f"))


@query("n18c_hessian_response", f"""d1 AS (SELECT {CC}, value, coalesce(lag(value) OVER wy, value) + coalesce(lead(value) OVER wy, value) - 2 * value AS yy, coalesce(lag(value) OVER wx, value) + coalesce(lead(value) OVER wx, value) - 2 * value AS xx, (coalesce(lead(value) OVER wy, value) - coalesce(lag(value) OVER wy, value)) / 2 AS dy FROM voxels WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)),
d2 AS (SELECT {CC}, yy, xx, (coalesce(lead(dy) OVER wx, dy) - coalesce(lag(dy) OVER wx, dy)) / 2 AS yx FROM d1 WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x)), d3 AS (SELECT {CC}, (yy + xx) / 2 + sqrt(((yy - xx) / 2) * ((yy - xx) / 2) + yx * yx) AS a, (yy + xx) / 2 - sqrt(((yy - xx) / 2) * ((yy - xx) / 2) + yx * yx) AS b FROM d2),
d4 AS (SELECT {CC}, CASE WHEN abs(a) > abs(b) THEN b ELSE a END AS l1, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS l2 FROM d3); SELECT {CC}, l1, l2, exp(-pow(abs(l1) / (abs(l2) + 1e-12), 2) / 0.5) * (1 - exp(-(l1 * l1 + l2 * l2) / 450)) AS line FROM d4""", "l1 l2 line")
def _(t):
    return wi.hessian_response(t.vox)


@query("n19_z_aggregate", f"; SELECT a.volume_id, a.z, a.y, a.x, avg(b.value) AS value, var_pop(b.value) AS variance FROM voxels a JOIN voxels b ON a.volume_id = b.volume_id AND a.y = b.y AND a.x = b.x AND b.z BETWEEN a.z - 1 AND a.z + 1 GROUP BY 1, 2, 3, 4 HAVING count(*) = 3", "value variance")
def _(t):
    return fe.z_aggregate(t.vox, 1)


@query("n19_feature_bank_v1")
def _(t):
    return fe.slice_features_v1(t.vox, t.dims, 1)


HOLES = f"bg AS (SELECT {CC} FROM voxels WHERE value < 160), " + sql_labels("bl", "bg", FLAT4) + f", outer_ AS (SELECT DISTINCT volume_id, label FROM bl WHERE y IN (0, 31) OR x IN (0, 31)), filled AS (SELECT {CC} FROM seed UNION SELECT {CC} FROM bl WHERE (volume_id, label) NOT IN (SELECT (volume_id, label) FROM outer_))"


@query("n20_fill_holes", HOLES + f"; SELECT {CC} FROM filled", small=True)
def _(t):
    return co.fill_holes(t.seed, t.dims)


@query("n21_closed_region_fill")
def _(t):
    return co.closed_region_fill(t.seed, t.dims)


# ---- components and regions


@query("c1_label_2d", LAB2 + f"; SELECT {CC}, label FROM lab")
def _(t):
    return t.flat


@query("c2_label_3d_6", LAB3 + f"; SELECT {CC}, label FROM lab")
def _(t):
    return t.solid


@query("c2_label_3d_26", "hi AS (SELECT * FROM seed WHERE (z + y + x) % 2 = 0 OR y % 3 = 0), " + sql_labels("lab", "hi", [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]) + f"; SELECT {CC}, label FROM lab")
def _(t):
    return co.label_3d(t.seed.where("(z + y + x) % 2 = 0 or y % 3 = 0"), t.dims, 26)


@query("c3_label_by_bins", f"{BINS}, " + sql_labels("lab", "bins", [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)], "bin") + f"; SELECT {CC}, bin, label FROM lab", small=True)
def _(t):
    return co.label_by_bins(px.value_bins(t.vox, 3), t.dims)


SIZES = "sizes AS (SELECT volume_id, label, count(*) AS size FROM lab GROUP BY 1, 2)"


@query("c4_remove_small", f"{LAB2}, {SIZES}; SELECT {CC}, label FROM lab JOIN sizes USING (volume_id, label) WHERE size >= 8")
def _(t):
    return co.remove_small(t.flat, 8)


@query("c5_intersect_regions", f"{LAB3}, o AS (SELECT volume_id, label, count(*) AS size, count(*) FILTER (value > 200) AS hit FROM lab JOIN voxels USING ({CC}) GROUP BY 1, 2); SELECT {CC} FROM lab JOIN o USING (volume_id, label) WHERE hit / size >= 0.3 AND size >= 4")
def _(t):
    return co.intersect_regions(derived.mask_above(t.vox, 200), t.solid, 0.3, 4)


@query("c6_intersect_dilated", f"top AS (SELECT {CC} FROM voxels WHERE value > 240), " + sql_dilate("di", "top", 3, 3, 3) + f"; SELECT {CC} FROM gt JOIN di USING ({CC})")
def _(t):
    return co.intersect_dilated(derived.mask_above(t.vox, 240), t.gt, 1, t.dims)


BASICS = "basics AS (SELECT volume_id, label, count(*) AS size, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM lab GROUP BY 1, 2)"


@query("c7_region_basics", f"{LAB3}, {BASICS}; SELECT *, size / ((z1 - z0) * (y1 - y0) * (x1 - x0)) AS extent, greatest(z1 - z0, y1 - y0, x1 - x0) / CASE WHEN z1 - z0 = 1 THEN least(y1 - y0, x1 - x0) ELSE least(z1 - z0, y1 - y0, x1 - x0) END AS bbox_aspect FROM basics", "extent bbox_aspect")
def _(t):
    return re_.region_basics(t.solid)


SUMS = ", ".join(f"sum({'*'.join(['v'] * p + ['u'] * q)}) AS s{p}{q}" for p in range(4) for q in range(4) if 1 <= p + q <= 3)
WHOLES = "n * s20 - s10 * s10 AS k20, n * s11 - s10 * s01 AS k11, n * s02 - s01 * s01 AS k02, n * n * s30 - 3 * n * s10 * s20 + 2 * s10 * s10 * s10 AS k30, n * n * s03 - 3 * n * s01 * s02 + 2 * s01 * s01 * s01 AS k03, n * n * s21 - 2 * n * s10 * s11 - n * s01 * s20 + 2 * s10 * s10 * s01 AS k21, n * n * s12 - 2 * n * s01 * s11 - n * s10 * s02 + 2 * s01 * s01 * s10 AS k12"
MOM = f"corner AS (SELECT volume_id, label, count(*)::HUGEINT AS n, min(y) AS y0, min(x) AS x0 FROM lab GROUP BY 1, 2), sums AS (SELECT volume_id, label, any_value(n) AS n, any_value(y0) AS y0, any_value(x0) AS x0, {SUMS} FROM (SELECT volume_id, label, n, y0, x0, (y - y0)::BIGINT AS v, (x - x0)::BIGINT AS u FROM lab JOIN corner USING (volume_id, label)) GROUP BY 1, 2), mom AS (SELECT volume_id, label, n::BIGINT AS n, n::DOUBLE AS m, y0 + s10::DOUBLE / n::DOUBLE AS cy, x0 + s01::DOUBLE / n::DOUBLE AS cx, {WHOLES} FROM sums)"
HU = "hu AS (SELECT *, (k20 + k02)::DOUBLE / (m * m * m) AS s, (k20 - k02)::DOUBLE / (m * m * m) AS t, k11::DOUBLE / (m * m * m) AS u, (k30 + k12)::DOUBLE / (m * m * m * m * sqrt(m)) AS a, (k21 + k03)::DOUBLE / (m * m * m * m * sqrt(m)) AS b, (k30 - 3 * k12)::DOUBLE / (m * m * m * m * sqrt(m)) AS c, (3 * k21 - k03)::DOUBLE / (m * m * m * m * sqrt(m)) AS d, k20::DOUBLE / (m * m) AS v20, k11::DOUBLE / (m * m) AS v11, k02::DOUBLE / (m * m) AS v02 FROM mom), hv AS (SELECT *, s AS hu1, t * t + 4 * u * u AS hu2, c * c + d * d AS hu3, a * a + b * b AS hu4, c * a * (a * a - 3 * (b * b)) + d * b * (3 * (a * a) - b * b) AS hu5, t * (a * a - b * b) + 4 * u * (a * b) AS hu6, d * a * (a * a - 3 * (b * b)) - c * b * (3 * (a * a) - b * b) AS hu7, (v20 + v02) / 2 + sqrt(((v20 - v02) / 2) * ((v20 - v02) / 2) + v11 * v11) AS l1, greatest(0, (v20 + v02) / 2 - sqrt(((v20 - v02) / 2) * ((v20 - v02) / 2) + v11 * v11)) AS l2r FROM hu), hw AS (SELECT *, CASE WHEN l2r < 1e-12 THEN 0 ELSE l2r END AS l2 FROM hv)"
HUS = ", ".join(f"hu{k}" for k in range(1, 8))


@query("c8_region_moments", f"{LAB2}, {MOM}, {HU}; SELECT volume_id, label, n AS size, cy, cx, 4 * sqrt(l1) AS major, 4 * sqrt(l2) AS minor, coalesce(sqrt(greatest(0, 1 - pow(sqrt(l2) / nullif(sqrt(l1), 0), 2))), 0) AS eccentricity, {HUS}, CAST(sign(hu5) * 9 + sign(hu6) * 3 + sign(hu7) AS INTEGER) AS signs FROM hw", f"cy cx major minor eccentricity {HUS.replace(',', '')}")
def _(t):
    signs = (F.signum("hu5") * 9 + F.signum("hu6") * 3 + F.signum("hu7")).cast("int").alias("signs")
    return re_.region_moments(t.flat).select("volume_id", "label", "size", "cy", "cx", "major", "minor", "eccentricity", *HUS.split(", "), signs)


PERIM = f"""inner_ AS (SELECT a.volume_id, a.z, a.y, a.x, a.label FROM lab a JOIN lab b ON a.volume_id = b.volume_id AND a.z = b.z AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 5),
border AS (SELECT {CC}, label FROM lab EXCEPT SELECT {CC}, label FROM inner_), code AS (SELECT a.volume_id, a.z, a.y, a.x, a.label, sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS c FROM border a JOIN border b ON a.volume_id = b.volume_id AND a.z = b.z AND a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
perim AS (SELECT volume_id, label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM code GROUP BY 1, 2)"""


@query("c9_region_perimeter", f"{LAB2}, {SIZES}, {PERIM}; SELECT volume_id, label, size, perimeter, CASE WHEN perimeter > 0 THEN 4 * pi() * size / (perimeter * perimeter + 1e-8) ELSE 0 END AS circularity FROM sizes JOIN perim USING (volume_id, label)", "perimeter circularity")
def _(t):
    return re_.region_perimeter(t.flat)


@query("c10_region_euler", f"{LAB2}, q AS (SELECT volume_id, z, label, qy, qx, sum(bit) AS b FROM (SELECT volume_id, z, label, y - dy AS qy, x - dx AS qx, CASE WHEN dy = 0 AND dx = 0 THEN 1 WHEN dy = 0 THEN 2 WHEN dx = 0 THEN 4 ELSE 8 END AS bit FROM lab, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx)) GROUP BY ALL); SELECT volume_id, label, CAST(sum(CASE WHEN b IN (1, 2, 4, 8) THEN 1 WHEN b IN (7, 11, 13, 14) THEN -1 WHEN b IN (6, 9) THEN -2 ELSE 0 END) // 4 AS BIGINT) AS euler FROM q GROUP BY 1, 2")
def _(t):
    return re_.region_euler(t.flat)


@query("c11_region_solidity")
def _(t):
    return re_.region_solidity(t.flat)


@query("c12_region_surface", f"{LAB3}, {SIZES}, core AS (SELECT a.volume_id, a.label, a.z, a.y, a.x FROM lab a JOIN lab b ON a.volume_id = b.volume_id AND a.label = b.label AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 27), k AS (SELECT volume_id, label, count(*) AS c FROM core GROUP BY 1, 2); SELECT volume_id, label, size, size - coalesce(c, 0) AS surface, (size - coalesce(c, 0)) / size AS surface_ratio, pow(size, 2 / 3) / (size - coalesce(c, 0)) AS sphericity FROM sizes LEFT JOIN k USING (volume_id, label)", "surface_ratio sphericity")
def _(t):
    return re_.region_surface(t.solid)


@query("c13_regionprops_3d")
def _(t):
    large = written(co.remove_small(t.solid, 20), "large")
    return re_.regionprops_3d(large, 20, t.dims).join(re_.region_solidity_3d(large).select("volume_id", "label", "solidity"), ["volume_id", "label"])


@query("c14_regionprops_2d")
def _(t):
    return re_.regionprops_2d(t.flat, 8)


def _templates(v: DataFrame) -> DataFrame:
    return v.where("size >= 10 and label % 3 = 0")


@query("c15_match_shapes")
def _(t):
    v = written(re_.shape_vectors(t.flat, t.dims), "vectors")
    return ma.match_shapes(v, _templates(v), 0.5, 0.5)


def _hu_vectors(t):
    m = re_.region_moments(t.flat)
    return written(m.select("volume_id", "label", "size", ma.hu_vector().alias("v")), "hu")


HU_V = f"{LAB2}, {MOM}, {HU}, u AS MATERIALIZED (SELECT volume_id, label, n AS size, [{', '.join(f'-sign(hu{k}) * log10(abs(hu{k}) + 1e-10)' for k in range(1, 8))}] AS v FROM hw)"
COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-8)"


@query("c16_filter_by_hu", f"{HU_V}, tp AS MATERIALIZED (SELECT size, v AS tv FROM u WHERE size >= 10 AND label % 3 = 0), e AS (SELECT min(size) AS lo, max(size) AS hi FROM tp); SELECT DISTINCT volume_id, label FROM u, e, (SELECT DISTINCT tv FROM tp) WHERE u.size >= 10 AND u.size >= lo * 0.5 AND u.size <= hi / 0.5 AND {COS.format('v', 'tv')} >= 0.999")
def _(t):
    v = _hu_vectors(t)
    return ma.filter_by_hu(v, _templates(v), 0.999, 0.5)


@query("c17_filter_by_geometry", f"{LAB2}, {BASICS}, g AS (SELECT volume_id, label, size, [size / ((y1 - y0) * (x1 - x0)), greatest(y1 - y0, x1 - x0) / least(y1 - y0, x1 - x0)] AS v FROM basics), tp AS (SELECT v AS tv FROM g WHERE size >= 10 AND label % 3 = 0), e AS (SELECT min(size) AS lo, max(size) AS hi FROM g WHERE size >= 10 AND label % 3 = 0); SELECT DISTINCT volume_id, label FROM g, tp, e WHERE size >= 10 AND size >= lo * 0.5 AND size <= hi / 0.5 AND (v[1] * tv[1] + v[2] * tv[2]) / (sqrt(v[1] * v[1] + v[2] * v[2]) * sqrt(tv[1] * tv[1] + tv[2] * tv[2]) + 1e-8) >= 0.9999")
def _(t):
    v = re_.region_basics(t.flat).select("volume_id", "label", "size", F.array("extent", "bbox_aspect").alias("v"))
    v = written(v, "geometry")
    return ma.filter_by_geometry(v, _templates(v), 0.9999, 0.5)


@query("c18_hu_similarity", f"{HU_V}; SELECT * FROM (SELECT a.volume_id, a.label AS label_a, b.label AS label_b, greatest(0, least(1, {COS.format('a.v', 'b.v')})) AS sim FROM u a JOIN u b USING (volume_id)) WHERE sim >= 0.9999", "sim")
def _(t):
    v = _hu_vectors(t)
    return ma.hu_similarity(v, v, 0.9999)


@query("c18_pca_iou")
def _(t):
    return ma.pca_iou(t.solid, t.solid.where("z % 2 = 0 or y % 2 = 0"))


@query("c19_filter_by_shape_3d")
def _(t):
    return ma.filter_by_shape_3d(t.solid, t.solid.where("label % 3 = 0"), 0.3)


@query("c20_filter_thin", f"{LAB2}, " + sql_erode("er", "seed", 3) + f", o AS (SELECT l.volume_id, l.label, count(*) AS size, count(e.volume_id) AS hit FROM lab l LEFT JOIN er e ON l.volume_id = e.volume_id AND l.z = e.z AND l.y = e.y AND l.x = e.x GROUP BY 1, 2); SELECT {CC} FROM lab JOIN o USING (volume_id, label) WHERE size BETWEEN 4 AND 1000 AND hit / size < 0.2")
def _(t):
    return co.filter_thin(t.flat, 4, 1000, 0.2)


@query("c21_edge_regions")
def _(t):
    t.kept()
    return co.edge_regions(t.pred.select(*C, F.col("edge").alias("value")), t.dims, 0.45, 5)


@query("c22_fill_edge_boxes")
def _(t):
    return ma.fill_edge_boxes(t.flat, re_.region_solidity(t.flat), 5, 1.5)


@query("c23_line_overlap", f"{LAB2}, o AS (SELECT volume_id, label, count(*) AS size, count(*) FILTER (value % 3 = 0) AS hit FROM lab JOIN voxels USING ({CC}) GROUP BY 1, 2); SELECT {CC} FROM lab JOIN o USING (volume_id, label) WHERE size >= 20 AND hit / size >= 0.33")
def _(t):
    return co.filter_by_line_overlap(t.flat, t.vox.where("value % 3 = 0"), 0.33)


@query("c24_perimeter_ratio")
def _(t):
    t.kept()
    line = written(co.label_3d(t.gt, t.dims, 6), "line")
    p = lambda df: re_.region_perimeter(df, 8, t.dims).select("volume_id", "label", "perimeter")
    return ma.filter_by_perimeter_ratio(p(t.solid), p(line), co.overlap_pairs(t.solid, line), 1.2, 3.0)


@query("c25_relabel_by_priority", f"cl AS (SELECT {CC}, CAST(floor(value / 86) AS INTEGER) AS label FROM voxels), s AS (SELECT volume_id, label, count(*) FILTER (z < 2 AND y < 8 AND x < 8) AS n FROM cl GROUP BY 1, 2), r AS (SELECT volume_id, label, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, label) - 1 AS INTEGER) AS rank FROM s); SELECT {CC}, rank AS label FROM cl JOIN r USING (volume_id, label)")
def _(t):
    return co.relabel_by_priority(t.vox.select(*C, F.floor(F.col("value") / 86).cast("int").alias("label")), (0, 2), (0, 8), (0, 8))


REFINED = "wide AS (SELECT volume_id, z, CAST(y // 4 * 4 + oy AS INTEGER) AS y, CAST(x // 4 * 4 + ox AS INTEGER) AS x FROM voxels, (SELECT unnest(range(0, 4)) AS oy), (SELECT unnest(range(0, 4)) AS ox) WHERE floor(value / 86) = 2 AND y % 4 = 2 AND x % 4 = 2), " + sql_dilate("gr", "wide", 3) + ", " + sql_erode("cl", "gr", 3)


@query("c26_refine_label", f"{REFINED}, " + sql_labels("rl", "cl", FLAT4) + f", big AS (SELECT volume_id, label FROM rl GROUP BY 1, 2 HAVING count(*) >= 16); SELECT {CC} FROM rl JOIN big USING (volume_id, label)")
def _(t):
    return co.refine_label(t.vox.select(*C, F.floor(F.col("value") / 86).cast("int").alias("label")), 2, t.dims, 4, 3, 16)


# ---- joins


@query("j1_align_layers", f"{PRED0}; SELECT p.volume_id, p.z, p.y, p.x, v.value, area, v.value >= 160 AS is_seed, v.value < 8 AS is_negative FROM pred p JOIN voxels v USING ({CC})", "value area")
def _(t):
    t.kept()
    name = lambda layer: f"layer_{uuid.uuid4().hex}_{layer}"
    stored = {layer: volumes.store_layer(rows, name(layer), 16) for layer, rows in {"raw": t.vox, "area": t.pred.select(*C, F.col("area").alias("value")), "is_seed": t.seed, "is_negative": t.negative}.items()}
    return volumes.align_stored(t.spark, stored["raw"], {"area": stored["area"]}, {k: stored[k] for k in ("is_seed", "is_negative")})


@query("j2_extract_patches", f"{PATCHES}; SELECT patch_id, v.z - p.z AS dz, v.y - y0 AS py, v.x - x0 AS px, value FROM patches p JOIN voxels v ON v.volume_id = p.volume_id AND v.z BETWEEN p.z - 1 AND p.z + 1 AND v.y BETWEEN y0 AND y0 + 11 AND v.x BETWEEN x0 AND x0 + 11", "value")
def _(t):
    return sa.extract_patches(_patches(t), t.vox, 12, 12, 1)


@query("j6_overlap_pairs", sql_labels("la", "seed", FLAT4) + ", " + sql_labels("lb", "gt", FLAT4) + f"; SELECT volume_id, la.label AS label_a, lb.label AS label_b, count(*) AS n FROM la JOIN lb USING ({CC}) GROUP BY 1, 2, 3", small=True)
def _(t):
    return co.overlap_pairs(t.flat, co.label_2d(t.gt, t.dims))


@query("x3_linear_index", f"; SELECT {CC}, (z::BIGINT * h + y) * w + x AS i FROM seed JOIN dims USING (volume_id)")
def _(t):
    return t.seed.join(t.dims, "volume_id").select(*C, linear_index(F.col("z"), F.col("y"), F.col("x"), F.col("h"), F.col("w")).alias("i"))


# ---- sets


for _name, _op, _f in (("u1_union", "UNION", mo.mask_union), ("u2_intersect", "INTERSECT", mo.mask_intersect), ("u3_except", "EXCEPT", mo.mask_except)):
    query(_name, f"odd AS (SELECT {CC} FROM voxels WHERE value % 2 = 1); SELECT {CC} FROM seed {_op} SELECT {CC} FROM odd")(lambda t, f=_f: f(t.seed, t.vox.where("value % 2 = 1")))


@query("u4_xor", "; SELECT doc_id FROM labels WHERE (quality = 1) <> (toxic = 1)", base=False)
def _(t):
    as_mask = lambda c: t.table("labels").where(f"{c} = 1").select(F.lit("v").alias("volume_id"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("doc_id").alias("x"))
    return mo.mask_xor(as_mask("quality"), as_mask("toxic")).select(F.col("x").alias("doc_id"))


@query("u5_distinct_labels", f"{LAB2}; SELECT volume_id, z, count(DISTINCT label) AS n FROM lab GROUP BY 1, 2")
def _(t):
    return t.flat.groupBy("volume_id", "z").agg(F.count_distinct("label").alias("n"))


# ---- metrics


P3 = f"{PREDS}, cut AS (SELECT run, volume_id, quantile_cont(area, 0.9) AS c FROM preds GROUP BY 1, 2), hit AS (SELECT run, {CC} FROM preds JOIN cut USING (run, volume_id) WHERE area >= greatest(c, 0.5)), cnt AS (SELECT run, volume_id, count(g.z) AS tp, count(*) - count(g.z) AS fp FROM hit h LEFT JOIN gt g USING ({CC}) GROUP BY 1, 2), iou AS (SELECT run, volume_id, tp, fp, n - tp AS fn, tp / (fp + n + 1e-8) AS iou, fp / (d::BIGINT * h * w - n + 1e-8) AS fpr, 2 * tp / (tp + fp + n) AS dice FROM cnt JOIN (SELECT volume_id, count(*) AS n FROM gt GROUP BY 1) USING (volume_id) JOIN dims USING (volume_id))"


def evaluated(t: Tables) -> DataFrame:
    """The minimum slice: percentile threshold of every run's prediction, IoU and FPR against the truth."""
    t.kept()
    hit = px.percentile_threshold(derived.predictions(t.vox), 0.9, 0.5, ("run", "volume_id"), "area")
    return me.iou_fpr(t.gt, hit, t.dims, ["run", "volume_id"])


@query("e1_iou_fpr", f"{P3}; SELECT run, volume_id, tp, fp, fn, iou, fpr, dice FROM iou", "iou fpr dice")
def _(t):
    return evaluated(t).select("run", "volume_id", "tp", "fp", "fn", "iou", "fpr", "dice")


@query("e2_dice", f"; SELECT volume_id, 2 * count(*) FILTER (value >= 160) / (count(*) FILTER (value > 128) + count(*) FILTER (value >= 160)) AS dice FROM voxels GROUP BY 1", "dice")
def _(t):
    return me.iou_fpr(t.gt, t.seed, t.dims, ["volume_id"]).select("volume_id", "dice")


GRID_KEYS = "lower(volume_id) AS cell, 'mito' AS organelle, 30 + 20 * run AS ratio, run AS trial, CASE WHEN run % 2 = 0 THEN 'own' ELSE 'other' END AS method"


@query("e3_evaluate_grid", f"{P3}; SELECT {GRID_KEYS}, volume_id, tp, fp, fn, iou, fpr, dice FROM iou UNION ALL SELECT lower(volume_id), 'mito', 99, 9, 'own', volume_id, 0, 0, count(*), 0, 0, 0 FROM gt GROUP BY volume_id", "iou fpr dice")
def _(t):
    t.kept()
    keys = ["cell", "organelle", "ratio", "trial", "method"]
    named = [F.lower("volume_id").alias("cell"), F.lit("mito").alias("organelle"), (30 + 20 * F.col("run")).alias("ratio"), F.col("run").alias("trial"), F.when(F.col("run") % 2 == 0, "own").otherwise("other").alias("method")]
    preds = derived.predictions(t.vox).select(*named, *C, F.col("area").alias("value"))
    runs = preds.select(*keys, "volume_id").distinct()
    empty = t.dims.select(F.lower("volume_id"), F.lit("mito"), F.lit(99), F.lit(9), F.lit("own"), "volume_id")  # a run without a prediction
    return me.evaluate_grid(t.gt, preds, runs.union(empty), t.dims, keys, 0.9, 0.5)


@query("e4_cross_model_matrix", f"{EV}; SELECT cell AS model_cell, avg(value) FILTER (method = 0) AS \"0\", avg(value) FILTER (method = 1) AS \"1\", avg(value) FILTER (method = 2) AS \"2\" FROM ev GROUP BY 1", '"0" "1" "2"', base=False)
def _(t):
    return me.cross_model_matrix(t.events.select(F.col("cell").alias("model_cell"), F.col("method").alias("data_cell"), F.col("value").alias("iou")), [0, 1, 2])


@query("e4_cross_model_totals", f"{EV}, c AS (SELECT CASE WHEN grouping(cell) = 1 THEN 'all' ELSE cell END AS model_cell, CASE WHEN grouping(ratio) = 1 THEN 'all' ELSE CAST(ratio AS VARCHAR) END AS ratio, CASE WHEN grouping(method) = 1 THEN 'all' ELSE CAST(method AS VARCHAR) END AS data_cell, avg(value) AS iou FROM ev GROUP BY CUBE (cell, method, ratio)); SELECT model_cell, ratio, any_value(iou) FILTER (data_cell = '0') AS \"0\", any_value(iou) FILTER (data_cell = '1') AS \"1\", any_value(iou) FILTER (data_cell = '2') AS \"2\", any_value(iou) FILTER (data_cell = 'all') AS \"all\" FROM c GROUP BY 1, 2", '"0" "1" "2" "all"', base=False)
def _(t):
    return me.cross_model_totals(t.events.select(F.col("cell").alias("model_cell"), F.col("method").alias("data_cell"), "ratio", F.col("value").alias("iou")), [0, 1, 2], ["ratio"])


@query("e5_box_summary", f"{EV}, q AS (SELECT ratio, method, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY 1, 2); SELECT ratio, method, n, q1, median, q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high FROM ev JOIN q USING (ratio, method) GROUP BY ALL", "q1 median q3 low high", base=False)
def _(t):
    return me.box_summary(t.events, ["ratio", "method"], "value")


@query("e6_histogram_correlation", f"{EV}, e AS (SELECT cell, log10(value + 1e-6) AS v FROM ev), r AS (SELECT min(v) AS lo, max(v) AS hi FROM e), b AS (SELECT cell, least(49, CAST(floor((v - lo) / (hi - lo) * 50) AS INTEGER)) AS bin, count(*) AS n FROM e, r GROUP BY 1, 2), f AS (SELECT c.cell, k.bin, coalesce(b.n, 0) * 50 / (c.all_ * (hi - lo)) AS density FROM (SELECT cell, count(*) AS all_ FROM e GROUP BY 1) c, r, (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS bin) k LEFT JOIN b ON b.cell = c.cell AND b.bin = k.bin); SELECT a.cell AS group_a, c.cell AS group_b, corr(a.density, c.density) AS r FROM f a JOIN f c USING (bin) WHERE a.cell < c.cell GROUP BY 1, 2", "r", base=False)
def _(t):
    return me.histogram_correlation(t.events, "cell", "value", 50, True)


ERFC = "(SELECT t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-zz * zz) FROM (SELECT zz, 1 / (1 + 0.3275911 * zz) AS t FROM (SELECT z / sqrt(2) AS zz)))"


@query("e7_mann_whitney", f"{EV}, s AS (SELECT cell, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rk FROM ev WHERE cell IN ('view', 'click')), m AS (SELECT count(*) FILTER (cell = 'view') AS n_a, count(*) FILTER (cell = 'click') AS n_b, sum(rk) FILTER (cell = 'view') - count(*) FILTER (cell = 'view') * (count(*) FILTER (cell = 'view') + 1) / 2 AS u FROM s), ti AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM s GROUP BY value)), zs AS (SELECT n_a, n_b, u, greatest(0, abs(u - n_a * n_b / 2) - 0.5) / sqrt(n_a * n_b / 12 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1)))) AS z FROM m, ti); SELECT n_a, n_b, u, {ERFC} AS p FROM zs", "u p", base=False)
def _(t):
    return me.mann_whitney(t.events, "cell", "value", "view", "click")


@query("e8_mean_diff_projection", "u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), w AS (SELECT k, avg(v) FILTER (label = 0) - avg(v) FILTER (label = 1) AS w FROM u GROUP BY 1), n AS (SELECT sqrt(sum(w * w)) + 1e-8 AS n FROM w), p AS (SELECT vec_id, sum(v * w / n) AS p FROM u JOIN w USING (k), n GROUP BY 1); SELECT vec_id, (p - min(p) OVER ()) / (max(p) OVER () - min(p) OVER () + 1e-8) AS p FROM p", "p", base=False)
def _(t):
    return me.mean_diff_projection(t.table("embeddings"), "vec_id", F.col("label") == 0, F.col("label") == 1, "embedding")


@query("e9_line_coefficient", EDGE + "; SELECT volume_id, 1.2 * (SELECT count(*) FROM edge e WHERE e.volume_id = s.volume_id) / count(*) AS ratio FROM seed s GROUP BY 1", "ratio")
def _(t):
    return me.line_coefficient(t.seed, t.dims)


LOGIT = f"lg AS (SELECT {CC}, (value - 128) / 64.0::DOUBLE AS logit, value / 254.0::DOUBLE AS img FROM voxels)"
LZERO = ", ".join([LOGIT, f"z0 AS (SELECT {CC}, logit, img AS s, img * img AS s2 FROM lg)", sql_win("z1", "z0", "y", 1, 1, "logit", "sum(s) OVER w AS s, sum(s2) OVER w AS s2"), sql_win("z2", "z1", "x", 1, 1, "logit", "sum(s) OVER w AS s, sum(s2) OVER w AS s2"), f"lz AS (SELECT {CC}, 1 / (1 + exp(-logit)) AS p, s / 9 AS mean, greatest(1e-6, s2 / 9 - s / 9 * (s / 9)) AS var FROM z2)"])


def _logit(t):
    return t.vox.select(*C, ((F.col("value") - 128) / 64.0).alias("logit"), (F.col("value") / 254.0).alias("img"))


@query("e10_region_consistency", f"{LZERO}, m AS (SELECT volume_id, z, sum(p) + 1e-6 AS w FROM lz GROUP BY 1, 2), mu AS (SELECT volume_id, z, any_value(w) AS w, sum(p / w * var) AS mv, sum(p / w * mean) AS mm FROM lz JOIN m USING (volume_id, z) GROUP BY 1, 2); SELECT volume_id, z, 0.1 * sum((var - mv) * (var - mv) * p / w) + 0.9 * sum((mean - mm) * (mean - mm) * p / w) AS score FROM lz JOIN mu USING (volume_id, z) GROUP BY 1, 2", "score")
def _(t):
    return me.region_consistency(_logit(t))


@query("e11_region_contrast", f"{LZERO}; SELECT volume_id, z, -(0.1 * abs(sum(var * p) / (sum(p) + 1e-6) - sum(var * (1 - p)) / (sum(1 - p) + 1e-6)) + 0.9 * abs(sum(mean * p) / (sum(p) + 1e-6) - sum(mean * (1 - p)) / (sum(1 - p) + 1e-6))) AS score FROM lz GROUP BY 1, 2", "score")
def _(t):
    return me.region_contrast(_logit(t))


WEIGHTS = RINGS + f", wt AS (SELECT v.volume_id, v.z, v.y, v.x, CASE WHEN value < 8 THEN 1.0::DOUBLE WHEN value >= 160 THEN 1 WHEN i.z IS NOT NULL THEN 0 WHEN o.z IS NOT NULL THEN 1 ELSE value / 2540.0::DOUBLE END AS weight FROM voxels v LEFT JOIN (SELECT * FROM rings WHERE ring = 'inner') i USING ({CC}) LEFT JOIN (SELECT * FROM rings WHERE ring = 'outer') o USING ({CC}))"


def _weights(t):
    rings = written(mo.dilated_rings(t.seed, t.dims, 1, 2), "rings")
    return me.supervision_weights(t.vox.select(*C, (F.col("value") / 2540.0).alias("soft")), t.seed, t.negative, rings)


@query("e12_supervision_weights", WEIGHTS + f"; SELECT {CC}, weight FROM wt", "weight")
def _(t):
    t.kept()
    return _weights(t)


@query("e13_weighted_bce", f"{WEIGHTS}, {LOGIT}; SELECT volume_id, z, avg(weight * (greatest(logit, 0) - logit * t + ln(1 + exp(-abs(logit))))) - avg(t / (1 + exp(-logit))) AS score FROM (SELECT l.*, weight, CASE WHEN s.z IS NULL THEN 0 ELSE 1 END AS t FROM lg l JOIN wt USING ({CC}) LEFT JOIN seed s USING ({CC})) GROUP BY 1, 2", "score")
def _(t):
    t.kept()
    target = volumes.to_dense(t.seed, t.dims).withColumnRenamed("value", "target")
    return me.weighted_bce(_logit(t).join(target, C).join(_weights(t), C))


@query("e13_edge_local_bce", f"{EDGE}, {LOGIT}; SELECT volume_id, z, avg(CASE WHEN e.y IS NULL THEN 0 ELSE greatest(logit, 0) - logit * (s.y IS NOT NULL)::INTEGER + ln(1 + exp(-abs(logit))) END) AS score FROM lg l LEFT JOIN edge e USING ({CC}) LEFT JOIN seed s USING ({CC}) GROUP BY 1, 2", "score")
def _(t):
    target = volumes.to_dense(t.seed, t.dims).withColumnRenamed("value", "target")
    return me.edge_local_bce(_logit(t).join(target, C), mo.edge_mask(t.seed, 1, t.dims))


@query("e14_smoothness", f"{LOGIT}, s AS (SELECT {CC}, img, 1 / (1 + exp(-logit)) AS p FROM lg), g AS (SELECT {CC}, coalesce((1 - exp(-abs(lead(img) OVER wx - img))) * abs(lead(p) OVER wx - p), 0) + coalesce((1 - exp(-abs(lead(img) OVER wy - img))) * abs(lead(p) OVER wy - p), 0) AS t FROM s WINDOW wx AS (PARTITION BY volume_id, z, y ORDER BY x), wy AS (PARTITION BY volume_id, z, x ORDER BY y)); SELECT volume_id, z, avg(t) AS score FROM g GROUP BY 1, 2", "score")
def _(t):
    return me.smoothness_score(_logit(t))


@query("e15_correlation", f"{PRED0}; SELECT volume_id, z, 1 - covar_pop(value, edge) * count(*) / (sqrt(var_pop(value) * count(*)) * sqrt(var_pop(edge) * count(*)) + 1e-6) AS score FROM pred JOIN voxels USING ({CC}) GROUP BY 1, 2", "score")
def _(t):
    return me.correlation_score(t.pred.join(t.vox, C).select(*C, F.col("value").alias("a"), F.col("edge").alias("b")))


# ---- sampling


@query("k1_sample_patches")
def _(t):
    return sa.sample_patches(written(t.seed, "seed"), written(t.negative, "negative"), t.dims, 100, 12, 12, 1)


@query("k1_order_index", f"; SELECT {CC}, row_number() OVER (PARTITION BY volume_id ORDER BY z, y, x) - 1 AS i, count(*) OVER (PARTITION BY volume_id) AS n FROM seed")
def _(t):
    return sa.order_index(t.seed)


@query("k2_sample_by_ratio", f"{PATCHES}, s AS (SELECT patch_id, p.volume_id, p.z, y0, x0, count(*) FILTER (value <> 0) / 144 AS im, count(*) FILTER (value >= 160) / 144 AS ma FROM patches p JOIN voxels v ON v.volume_id = p.volume_id AND v.z = p.z AND v.y BETWEEN y0 AND y0 + 11 AND v.x BETWEEN x0 AND x0 + 11 GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY patch_id) AS k FROM s WHERE im >= 0.5 AND ma >= 0.2); SELECT patch_id, volume_id, z, y0, x0 FROM o WHERE k <= 5")
def _(t):
    return sa.sample_patches_by_ratio(_patches(t), t.vox, t.seed, 12, 12, 0.5, 0.2, 5)


@query("k3_sample_point", f"p AS (SELECT volume_id, d, h, w, min({{'k': {HASH.format('(z::BIGINT * h + y) * w + x', 3 * 40503)}, 'z': z, 'y': y, 'x': x}}) AS p FROM seed JOIN dims USING (volume_id) GROUP BY ALL); SELECT volume_id, CAST(greatest(0, least(d - 1, p.z)) AS INTEGER) AS z, CAST(greatest(4, least(h - 5, p.y)) AS INTEGER) AS y, CAST(greatest(4, least(w - 5, p.x)) AS INTEGER) AS x FROM p")
def _(t):
    return sa.sample_point(t.seed, t.dims, 8, 8, 0, 3)




@query("k4_drop_regions", f"{LAB2}, k AS (SELECT volume_id, label, row_number() OVER (PARTITION BY volume_id ORDER BY {HASH.format('label', 5 * 40503)}, label) AS k, count(*) OVER (PARTITION BY volume_id) AS n FROM (SELECT DISTINCT volume_id, label FROM lab)); SELECT {CC}, label FROM lab JOIN k USING (volume_id, label) WHERE k > floor(n * 0.5)")
def _(t):
    return sa.drop_regions(t.flat, 0.5, 5)


@query("k5_drop_region_slices", f"{LAB3}, k AS (SELECT volume_id, label, z, row_number() OVER (PARTITION BY volume_id, label ORDER BY {HASH.format('label * 31 + z', 5 * 40503)}, z) AS k, count(*) OVER (PARTITION BY volume_id, label) AS n FROM (SELECT DISTINCT volume_id, label, z FROM lab)); SELECT {CC}, label FROM lab JOIN k USING (volume_id, label, z) WHERE n = 1 OR k > greatest(1, floor(n * 0.5))")
def _(t):
    return sa.drop_region_slices(t.solid, 0.5, 5)


@query("k6_sparse_annotations")
def _(t):
    return sa.sparse_annotations(t.vox, t.dims, [30, 50, 70, 80, 95])


@query("k7_soften_mask", f"c AS (SELECT volume_id, z, avg(y) AS cy, avg(x) AS cx, count(*) AS n FROM seed GROUP BY 1, 2), k AS (SELECT {CC}, n, row_number() OVER (PARTITION BY volume_id, z ORDER BY -ln(({HASH.format('(z::BIGINT * h + y) * w + x', 7 * 40503)} + 1) / 4294967297.0::DOUBLE) / exp(-0.1::DOUBLE * sqrt(pow(y - cy, 2) + pow(x - cx, 2))), y, x) AS k FROM seed JOIN c USING (volume_id, z) JOIN dims USING (volume_id)), picks AS (SELECT {CC} FROM k WHERE k <= floor(n * 0.05::DOUBLE)), " + sql_dilate("near", "picks", 3) + f"; SELECT {CC} FROM seed EXCEPT SELECT {CC} FROM near")
def _(t):
    return sa.soften_mask(t.seed, t.dims, 0.05, 0.1, 7)


# ---- scoring and jobs


TILES = """og AS (SELECT volume_id, z, least(sy, 32 - 12) AS y0, least(sx, 32 - 12) AS x0 FROM vols, zs, (SELECT unnest(range(0, 32, 9)) AS sy), (SELECT unnest(range(0, 32, 9)) AS sx) WHERE z >= 1 AND z < (SELECT max(d) FROM dims) - 1)"""


def _scores(t, fuse: str, threshold: float = 0.6) -> DataFrame:
    features = t.vox.select(*C, F.array("value", F.lit(1.0)).alias("f"))
    return scoring.score_tiles(features, lambda b: b["features"] @ np.array([1 / 64, -2.0]), t.dims, 12, 9, 1, fuse, threshold=threshold)


@query("i1_score_tiles", f"{TILES}, m AS (SELECT DISTINCT {CC}, 1 / (1 + exp(-(v.value / 64 - 2))) AS value FROM og JOIN voxels v USING (volume_id, z) WHERE v.y BETWEEN y0 AND y0 + 11 AND v.x BETWEEN x0 AND x0 + 11); SELECT v.volume_id, v.z, v.y, v.x, CASE WHEN v.z BETWEEN 1 AND d - 2 THEN m.value ELSE 0 END AS value FROM voxels v JOIN dims USING (volume_id) LEFT JOIN m USING ({CC})", "value")
def _(t):
    return _scores(t, "avg")


@query("i3_max_fusion", f"{TILES}; SELECT {CC}, CASE WHEN z IN (SELECT z FROM og) AND 1 / (1 + exp(-(value * 0.015625::DOUBLE - 2))) > 0.6 THEN 1.0::DOUBLE ELSE 0 END AS value FROM voxels", "value")
def _(t):
    return _scores(t, "max")


@query("i2_score_slices", f"sl AS (SELECT {CC}, CASE WHEN z BETWEEN 1 AND d - 2 THEN 1 / (1 + exp(2 - value / 64)) ELSE 0 END AS value FROM voxels JOIN dims USING (volume_id)), " + sql_gauss("sm", "sl", (0, 1, 1)) + f"; SELECT {CC}, value FROM sm", "value")
def _(t):
    f = t.vox.select(*C, F.array(F.col("value").cast("float")).alias("f"))
    return scoring.score_slices(f, lambda b: b["features"][..., 0] / 64 - 2, t.dims, 1, (0, 1, 1))


@query("i4_cluster_voxels")
def _(t):
    t.kept()
    return scoring.cluster_voxels(t.vox.select(*C, F.array(F.col("value"), F.col("z").cast("double")).alias("f")))


@query("i5_texture_mask")
def _(t):
    t.kept()
    f = t.vox.select(*C, F.array(F.col("value")).alias("f"))
    return jobs.texture_mask(f, t.vox, t.dims, ((0, 2), (0, 8), (0, 8)))


@query("i6_clean_volume")
def _(t):
    t.kept()
    return jobs.clean_volume(t.pred.select(*C, F.col("area").alias("value")), t.dims)


@query("l1_fuse_labels", f"odd AS (SELECT {CC} FROM voxels WHERE value % 2 = 1); SELECT {CC} FROM voxels WHERE (value > 200 OR value >= 160 OR value % 2 = 1) AND value >= 8")
def _(t):
    return jobs.fuse_labels(t.vox.where("value % 2 = 1"), derived.mask_above(t.vox, 200), t.seed, t.negative)


@query("l2_candidate_mask_0", f"{PRED0}, c AS (SELECT volume_id, quantile_cont(area, 0.9) AS c FROM pred GROUP BY 1); SELECT {CC} FROM pred JOIN c USING (volume_id) WHERE area >= greatest(c, 0.2)")
def _(t):
    t.kept()
    return jobs.candidate_mask(t.pred, t.dims, 0)


@query("l2_candidate_mask_1")
def _(t):
    t.kept()
    # dark lines around bright regions
    return jobs.candidate_mask(t.pred.withColumn("edge", 1 - F.col("edge")), t.dims, 1, threshold=0.6, lo=5)


@query("l2_candidate_mask_2")
def _(t):
    t.kept()
    return jobs.candidate_mask(t.pred, t.dims, 2)


@query("l3_refine_round")
def _(t):
    t.kept()
    return jobs.refine_round(t.pred, derived.mask_above(t.vox, 240), t.seed, t.negative, t.dims, hull_times=1.3, line_share=0.3)


@query("l4_propagate_labels")
def _(t):
    t.kept()
    def scorer(r):
        # brighter is likelier, less so far from what is known
        return r.voxels.join(r.soft.withColumnRenamed("value", "far"), C).select(*C, (F.col("value") - F.col("far")).alias("area"), (1 - F.col("value")).alias("edge"))

    return jobs.propagate_labels(t.vox, t.seed, t.negative, t.dims, scorer, new_path(t.spark, "rounds"), 2, hull_times=1.3, line_share=0.3)


@query("t1_streaming_iou", f"{P3}; SELECT run, volume_id, tp, fp, fn, iou, fpr, dice FROM iou", "iou fpr dice")
def _(t):
    t.kept()
    from .streaming.iou import prediction_stream, streaming_iou, with_ends

    root = new_path(t.spark, "stream")
    hit = px.percentile_threshold(derived.predictions(t.vox), 0.9, 0.5, ("run", "volume_id"), "area").select("run", *C)
    with_ends(hit).repartition(4, "z").write.parquet(f"{root}/in")
    out = streaming_iou(written(t.gt, "gt"), prediction_stream(t.spark, f"{root}/in", files=2), t.dims, f"{root}/counts", f"{root}/checkpoint")
    return out.select("run", "volume_id", "tp", "fp", "fn", "iou", "fpr", "dice")
