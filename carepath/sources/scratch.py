"""Tables that a job writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Where stored tables lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a folder of its own and a cluster is refused,
    since no machine-local folder can be read by every executor.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("carepath.shared.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="carepath-")
        spark.conf.set("carepath.shared.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *, tidy: bool = False) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it again.

    This cuts the lineage with replicated files, so a lost executor costs no recomputation
    of what stands above. With `tidy` the shuffle files of the writing go as it ends, not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, since what follows them is stored itself."""
    for df in tables:
        if (path := _PATHS.pop(df, None)) is not None:
            context = df.sparkSession.sparkContext
            found = context._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(context._jsc.hadoopConfiguration()).delete(found, True)
