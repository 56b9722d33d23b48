"""Tables on disk: replacing patients in a partitioned table, incremental merges, resumable work, time to live."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a patient table, by a hash of the patient.
PARTS = 64


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replace_patients(new: DataFrame, path: str, key: str = "patient") -> None:
    """Puts `new` in place of all earlier rows of its patients; other patients' rows stay.

    Only the partitions that hold these patients are written again, from a staged copy. A run that
    fails before the copy is whole leaves the table as it was and no copy. Partitions are then replaced
    one by one; a run that fails there leaves the copy beside the table, and saving once more mends it.
    """
    spark = new.sparkSession
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    new = new.withColumn("part", _part(F.col(key)))
    try:
        new.write.partitionBy("part").parquet(f"{staged}/new")
        new = spark.read.schema(new.schema).parquet(f"{staged}/new")
        if _exists(spark, path):
            old = spark.read.parquet(path).join(F.broadcast(new.select("part").distinct()), "part", "left_semi")  # at most PARTS rows
            old.join(new.select(key).distinct(), key, "left_anti").unionByName(new).write.partitionBy("part").parquet(f"{staged}/all")
            new = spark.read.schema(new.schema).parquet(f"{staged}/all")
    except Exception:
        _delete(spark, staged)
        raise
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    _delete(spark, staged)


def load_patient(spark: SparkSession, path: str, patient: str, key: str = "patient") -> DataFrame:
    """One patient's rows; reads one partition."""
    return spark.read.parquet(path).where((F.col("part") == _part(F.lit(patient))) & (F.col(key) == patient)).drop("part")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without one of their ends; must be empty before a graph is saved."""
    ends = nodes.select("patient", "node")
    src = edges.join(ends.withColumnRenamed("node", "src"), ["patient", "src"], "left_anti")
    return src.unionByName(edges.join(ends.withColumnRenamed("node", "dst"), ["patient", "dst"], "left_anti")).distinct()


def merge_plan(old: DataFrame, new: DataFrame, key: str, content: Sequence[str]) -> dict[str, DataFrame]:
    """keep (rows of `old` that are unchanged), drop (ids that went or changed) and insert (rows of `new` to add)."""
    same = [key, *content]
    on = lambda a, b: [a[c].eqNullSafe(b[c]) for c in same]
    keep = old.join(new.select(*same), on(old, new), "left_semi")
    return {"keep": keep, "drop": old.join(keep.select(key), key, "left_anti").select(key), "insert": new.join(old.select(*same), on(new, old), "left_anti")}


def todo(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The work that no earlier result with the same keys covers."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def live(pending: DataFrame, at: str, now: Column, hours: int = 1) -> DataFrame:
    """Pending rows younger than their time to live."""
    return pending.where(F.col(at) > now - F.make_dt_interval(F.lit(0), F.lit(hours)))


def meta_upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Key/value rows with the new values in place of the old."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
