"""Reading, writing and reshaping volumes: layers, axis order, dense and sparse layouts, blocks, runs and composites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .derived import C, grid
from .store import new_path, written


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """A voxel table (volume_id, z, y, x, value) from Parquet."""
    return spark.read.parquet(path).select(*C, F.col("value").cast("double"))


def read_raw_tiles(spark: SparkSession, path: str, shape: tuple[int, int, int], dtype: str = "uint8") -> DataFrame:
    """Voxels of raw uncompressed files, one volume a file, named by the file."""
    d, h, w = shape

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["volume_id"], f["content"]):
                data = np.frombuffer(raw, dtype).reshape(d, h, w)
                for z in range(d):
                    y, x = np.divmod(np.arange(h * w), w)
                    yield pd.DataFrame({"volume_id": name, "z": z, "y": y, "x": x, "value": data[z].reshape(-1).astype(float)})

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+?)(\\.[^./]*)?$", 1).alias("volume_id"), "content")
    return files.mapInPandas(run, "volume_id string, z int, y int, x int, value double")


def write_layer(df: DataFrame, root: str) -> None:
    """Write (volume_id, layer, resolution, z, y, x, value) for partition pruning by layer and resolution."""
    df.write.mode("append").partitionBy("layer", "resolution", "volume_id").parquet(root)


def read_layer(spark: SparkSession, root: str, layer: str, resolution: str) -> DataFrame:
    return spark.read.parquet(root).where((F.col("layer") == layer) & (F.col("resolution") == resolution)).select(*C, "value")


def transpose_axes(df: DataFrame, order: tuple[int, int, int]) -> DataFrame:
    """Axis k of the result is axis order[k] of the input, as numpy.transpose."""
    axes = C[1:]
    moved = [F.col(axes[o]).alias(axes[k]) for k, o in enumerate(order)]
    return df.select("volume_id", *moved, *[c for c in df.columns if c not in C])


def resolve_negative(requests: DataFrame, by_mask: DataFrame, by_raw: DataFrame) -> DataFrame:
    """The negative voxels of each request (request_id, mask_id, raw_id): its mask's own if that file exists, else its
    raw volume's, else none. by_mask and by_raw: (file_id, z, y, x)."""
    own = by_mask.select(F.col("file_id").alias("mask_id")).distinct().withColumn("own", F.lit(True))
    chosen = requests.join(own, "mask_id", "left").select(
        "request_id", F.when(F.col("own"), F.col("mask_id")).alias("m"), F.when(F.col("own").isNull(), F.col("raw_id")).alias("r")
    )
    a = chosen.join(by_mask, F.col("m") == F.col("file_id")).select("request_id", "z", "y", "x")
    b = chosen.join(by_raw, F.col("r") == F.col("file_id")).select("request_id", "z", "y", "x")
    return a.unionByName(b)


def write_labels(df: DataFrame, path: str, iteration: int) -> None:
    """A round's labels under its iteration; writing a round again replaces it alone."""
    rows = df.withColumn("iteration", F.lit(iteration))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration", "volume_id").parquet(path)


def ensure_features(spark: SparkSession, df: DataFrame, path: str, compute, thickness: int = 2) -> DataFrame:
    """Slices missing from the store at path are computed and appended; returns the store.

    compute(rows) gets the missing slices and `thickness` slices on either side of them, so that slabs are whole; of what
    it gives, the missing slices alone are kept.
    """
    slices = ["volume_id", "z"]
    missing = df.select(*slices).distinct()
    try:
        missing = missing.join(spark.read.parquet(path).select(*slices).distinct(), slices, "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    missing = written(missing, "missing")
    made = compute(df.limit(0))
    if missing.head(1):
        near = missing.withColumn("z", F.explode(F.sequence(F.col("z") - thickness, F.col("z") + thickness))).distinct()
        made = compute(df.join(near, slices, "left_semi")).join(missing, slices, "left_semi")
        made.write.mode("append").partitionBy("volume_id").parquet(path)
    return spark.read.schema(made.schema).parquet(path).select(made.columns)


def to_sparse(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where(F.col(col) != 0).select(*C)


def to_dense(mask: DataFrame, dims: DataFrame) -> DataFrame:
    """(C, value 0/1) over the whole grid of dims."""
    ones = mask.select(*C).distinct().withColumn("one", F.lit(1))
    return grid(dims).join(ones, C, "left").select(*C, F.coalesce("one", F.lit(0)).alias("value"))


def to_blocks(df: DataFrame, tile: tuple[int, int, int] = (1, 256, 256)) -> DataFrame:
    """Tiles (volume_id, z0, y0, x0, d, h, w, data float32): one row a tile, missing voxels 0."""
    d, h, w = tile
    keys = [F.expr(f"cast({a} div {n} * {n} as int)").alias(f"{a}0") for a, n in zip("zyx", tile)]

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        z, y, x = (f[a].to_numpy() - f[f"{a}0"].to_numpy() for a in "zyx")
        data = np.zeros((z.max() + 1, y.max() + 1, x.max() + 1), np.float32)
        data[z, y, x] = f["value"]
        row = {"volume_id": f["volume_id"].iloc[0], **{f"{a}0": f[f"{a}0"].iloc[0] for a in "zyx"}}
        return pd.DataFrame([row | dict(zip("dhw", data.shape)) | {"data": data.tobytes()}])

    schema = "volume_id string, z0 int, y0 int, x0 int, d int, h int, w int, data binary"
    return df.select(*C, "value", *keys).groupBy("volume_id", "z0", "y0", "x0").applyInPandas(pack, schema)


def to_voxels(blocks: DataFrame) -> DataFrame:
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                data = np.frombuffer(r.data, np.float32).reshape(r.d, r.h, r.w)
                z, y, x = (a.reshape(-1).astype(np.int32) for a in np.indices(data.shape))
                yield pd.DataFrame({"volume_id": r.volume_id, "z": z + r.z0, "y": y + r.y0, "x": x + r.x0, "value": data.reshape(-1).astype(float)})

    return blocks.mapInPandas(unpack, "volume_id string, z int, y int, x int, value double")


def scaled_minmax(df: DataFrame, cols: list[str], eps: float = 1e-8) -> DataFrame:
    """Each column by its volume's range: (v - min) / (max - min + eps)."""
    ends = written(df.groupBy("volume_id").agg(*[F.min(c).alias(f"{c}_lo") for c in cols], *[F.max(c).alias(f"{c}_hi") for c in cols]), "ends")
    both = df.join(ends, "volume_id")
    return both.select(*C, *[((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo") + F.lit(eps))).alias(c) for c in cols])


def compose_rgb(layers: DataFrame, r: str, g: str, b: str) -> DataFrame:
    """8-bit composite of three layers, each scaled to its volume's range and truncated."""
    byte = lambda c, n: F.floor(F.col(c) * 255).cast("int").alias(n)
    return scaled_minmax(layers, [r, g, b]).select(*C, byte(r, "r"), byte(g, "g"), byte(b, "b"))


def compose_channels(layers: DataFrame, channels: list[str]) -> DataFrame:
    """(C, channel, value): values * 255 clipped to 0..255 and truncated, a row for each channel."""
    byte = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c) * 255))).cast("int").alias(c)
    return layers.select(*C, *[byte(c) for c in channels]).unpivot(C, channels, "channel", "value")


def overlay_classes(raw: DataFrame, preds: DataFrame, colors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(C, r, g, b): the raw grey value, or the colour of the last class whose prediction exceeds the threshold.

    preds: (C, class, p); colors: (class, place, r, g, b), a later place overwrites.
    """
    top = preds.where(F.col("p") > threshold).join(F.broadcast(colors.select("class", "place")), "class").groupBy(*C).agg(F.max("place").alias("place"))
    of = colors.groupBy("place").agg(F.max(F.struct("r", "g", "b")).alias("c"))
    grey = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("value")))).cast("int")
    return raw.join(top, C, "left").join(F.broadcast(of), "place", "left").select(*C, *[F.coalesce(F.col(f"c.{k}"), grey).alias(k) for k in "rgb"])


def write_regions_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def run_keys(name: Column) -> list[Column]:
    """cell, organelle, ratio and trial of names like label_{cell}_{organelle}_{ratio}[_{trial}]."""
    pattern = "^[a-z]+_([^_]+)_([^_]+)_([0-9]+)(?:_([0-9]+))?$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    number = lambda k: F.when(part(k) != "", part(k).cast("int"))
    return [part(1).alias("cell"), part(2).alias("organelle"), number(3).alias("ratio"), number(4).alias("trial")]


def pending_runs(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected runs that are not done."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def append_results(spark: SparkSession, expected: DataFrame, path: str, keys: list[str], evaluate) -> DataFrame:
    """Evaluate the expected runs that the table at path lacks and append their rows (keys and results) to it; returns it.

    evaluate(runs) gives the rows of the pending runs; a job that is started again goes on where the table ends.
    """
    try:
        pending = pending_runs(expected, spark.read.parquet(path), keys)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        pending = expected
    pending = written(pending, "pending")
    if pending.head(1):
        evaluate(pending).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def align_layers(base: DataFrame, values: dict[str, DataFrame], masks: dict[str, DataFrame]) -> DataFrame:
    """base (C, ...) with a column for each further layer: the value of (C, value) layers, null where they lack the voxel,
    and whether (C) masks hold it. One equi-join on voxels a layer, all on the same key."""
    for name, layer in values.items():
        base = base.join(layer.select(*C, F.col("value").alias(name)), C, "left")
    for name, mask in masks.items():
        base = base.join(mask.select(*C).distinct().withColumn(name, F.lit(True)), C, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return base


#: Lets joins on voxels keep to tables that are bucketed by slice.
_BY_SLICE = "spark.sql.requireAllClusterKeysForCoPartition"


def store_layer(df: DataFrame, name: str, buckets: int = 200) -> str:
    """Store a layer (C, ...) as a table of the catalog, bucketed by slice; returns the name.

    Layers of one number of buckets lie alike, so voxels of several layers meet without an exchange.
    """
    rows = df.repartition(buckets, "volume_id", "z")
    rows.write.mode("overwrite").bucketBy(buckets, "volume_id", "z").sortBy(*C).option("path", new_path(df.sparkSession, name)).saveAsTable(name)
    return name


def joined_stored(spark: SparkSession, base: str, values: dict[str, str], masks: dict[str, str]) -> DataFrame:
    """align_layers of layers stored by store_layer. Masks must not repeat a voxel."""
    out = spark.table(base)
    for name, layer in values.items():
        out = out.join(spark.table(layer).select(*C, F.col("value").alias(name)).hint("merge"), C, "left")
    for name, mask in masks.items():
        out = out.join(spark.table(mask).select(*C, F.lit(True).alias(name)).hint("merge"), C, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def align_stored(spark: SparkSession, base: str, values: dict[str, str], masks: dict[str, str]) -> DataFrame:
    """The same as a stored table, from a plan without an exchange."""
    before = spark.conf.get(_BY_SLICE)
    spark.conf.set(_BY_SLICE, "false")
    try:
        return written(joined_stored(spark, base, values, masks), "aligned")
    finally:
        spark.conf.set(_BY_SLICE, before)


def available_runs(expected: DataFrame, present: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with a prediction, and whether they have a baseline: a missing baseline drops the baseline alone."""
    own = expected.join(present.select(*keys).distinct(), keys, "left_semi")
    base = baseline.select(*keys).distinct().withColumn("has_baseline", F.lit(True))
    return own.join(base, keys, "left").withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))
