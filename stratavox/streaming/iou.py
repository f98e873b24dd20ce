"""Running agreement of predictions with the truth as slices arrive.

The stream holds the voxels (run, volume_id, z, y, x) that a run predicts; a row without y ends its slice. While a slice is
open its state is one bit a voxel, so that repeated voxels count once; when it ends, its counts leave and its state goes.
What comes late for a slice that has ended changes nothing; it opens a state that the slice's next end removes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.metrics import rates
from ..sources.derived import C

SLICE = ["run", "volume_id", "z"]
COUNTS = "run int, volume_id string, z int, tp long, fp long, ended boolean"


def prediction_stream(spark: SparkSession, path: str, schema: str = "run int, volume_id string, z int, y int, x int", files: int = 1) -> DataFrame:
    """Prediction rows of Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def with_ends(rows: DataFrame) -> DataFrame:
    """rows and, for each slice in them, the row that ends it."""
    return rows.unionByName(rows.select(*SLICE).distinct().select(*SLICE, F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("x")))


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen, tp, fp = state.get if state.exists else (b"", 0, 0)
    bits, ended = np.frombuffer(seen, np.uint8).copy(), False
    for f in frames:
        ended |= bool(f["y"].isna().any())
        f = f[f["y"].notna()]
        if not len(f):
            continue
        area = int(f["area"].iloc[0])
        bits = bits if len(bits) else np.zeros(-(-area // 8), np.uint8)
        at, first = np.unique((f["y"] * f["w"] + f["x"]).to_numpy(np.int64), return_index=True)
        hit = f["hit"].to_numpy(bool)[first]
        new = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 0
        np.bitwise_or.at(bits, at[new] >> 3, np.left_shift(1, at[new] & 7).astype(np.uint8))
        tp, fp = tp + int((new & hit).sum()), fp + int((new & ~hit).sum())
    if ended:
        if state.exists:
            state.remove()
    else:
        state.update((bits.tobytes(), tp, fp))
    yield pd.DataFrame({"run": [key[0]], "volume_id": [key[1]], "z": [key[2]], "tp": [tp], "fp": [fp], "ended": [ended]})


def streaming_counts(gt: DataFrame, stream: DataFrame, dims: DataFrame) -> DataFrame:
    """(run, volume_id, z, tp, fp, ended) of the slices that a batch had rows for; voxels outside of their volume are left
    out."""
    truth = gt.select(*C).distinct().withColumn("hit", F.lit(True))
    rows = stream.join(dims.select("volume_id", "h", "w"), "volume_id").where("y is null or (y >= 0 and y < h and x >= 0 and x < w)")
    rows = rows.join(truth, C, "left").select(*SLICE, "y", "x", "w", (F.col("h") * F.col("w")).alias("area"), F.coalesce("hit", F.lit(False)).alias("hit"))
    return rows.groupBy(*SLICE).applyInPandasWithState(_count, COUNTS, "seen binary, tp long, fp long", "update", GroupStateTimeout.NoTimeout)


def slice_counts(batches: DataFrame) -> DataFrame:
    """The counts that hold for each slice (run, volume_id, z, tp, fp): those it ended with first, else the latest."""
    order = F.struct(F.col("ended").cast("int").alias("e"), F.when(F.col("ended"), -F.col("batch")).otherwise(F.col("batch")).alias("b"))
    return batches.groupBy(*SLICE).agg(F.max_by(F.struct("tp", "fp"), order).alias("c")).select(*SLICE, "c.tp", "c.fp")


def finished_rates(counts: DataFrame, gt: DataFrame, dims: DataFrame) -> DataFrame:
    """iou, fpr and dice of the counts of runs and volumes."""
    size = gt.select(*C).distinct().groupBy("volume_id").agg(F.count("*").alias("n"))
    both = counts.join(size, "volume_id", "left").join(dims, "volume_id")
    both = both.select("run", "volume_id", "tp", "fp", (F.coalesce("n", F.lit(0)) - F.col("tp")).alias("fn"), (F.col("d").cast("long") * F.col("h") * F.col("w")).alias("total"))
    return rates(both, F.col("total")).drop("total")


def streaming_iou(gt: DataFrame, stream: DataFrame, dims: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run the stream over all that is there and return its rates so far.

    Each micro-batch writes the counts of the slices it had rows for to a folder of its number under path; a batch that
    runs again replaces its own.
    """

    def write(counts: DataFrame, batch: int) -> None:
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    counts = streaming_counts(gt, stream, dims)
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = gt.sparkSession.read.schema(COUNTS + ", batch long").parquet(path)
    total = slice_counts(rows).groupBy("run", "volume_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    return finished_rates(total, gt, dims)
