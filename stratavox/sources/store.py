"""Tables in the shared folder: they cut lineage, survive lost executors and are removed when nothing reads them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_FOLDER: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh local one where it is unset (local mode only)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FOLDER:
        _FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="spark-stratavox-")
    return _FOLDER[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/stratavox/{tag}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Has Spark delete a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries run within end with them; for queries whose results are read from elsewhere."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables that are written on the way and removed together; as a context, at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
        """Write df as Parquet (with a codec other than the session's) to the shared folder and read it back: lineage
        ends there, and sizes are known."""
        path = new_path(self.spark, tag)
        self.paths.append(path)
        with _shuffles_end(self.spark):
            df.write.parquet(path, compression=codec)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        while self.paths:
            removed(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.remove()


_SCOPES: list[Scratch] = []


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what `written` stores within; for steps whose result is stored elsewhere before they end."""
    with Scratch(spark) as scope:
        _SCOPES.append(scope)
        try:
            yield
        finally:
            _SCOPES.remove(scope)


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same for a table that a result goes on reading; it stays until the innermost passing_tables ends, or else until
    the shared folder is cleared."""
    return (_SCOPES[-1] if _SCOPES else Scratch(df.sparkSession)).written(df, tag)
