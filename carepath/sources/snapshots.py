"""Tables whose versions are whole: data in folders that never change, and manifests that name them.

A manifest lists the folder of every partition. A new version writes the partitions that change to
a folder of its own and is there once its manifest is, which the file system creates at one stroke
or refuses. Who reads pins a manifest and sees that version whatever is written meanwhile; a run
that dies before its manifest leaves the last version as it was. Two writers of one version collide
and the second is told. Leases say who works on what until when.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


class Conflict(RuntimeError):
    """Another writer has published this version or holds this lease."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file that must not be there yet, whole or not at all: written aside and then created by a rename that refuses to replace."""
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise Conflict(path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise Conflict(path)


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _name(version: int) -> str:
    return f"{version:012}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that were published, in order."""
    fs, p = _fs(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[:12]) for n in names if len(n) == 17 and n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[str, str]]:
    """A version and the folder of each of its partitions; version 0 is the empty table."""
    if version is None:
        version = max(versions(spark, path), default=0)
    return version, json.loads(_text(spark, f"{path}/manifests/{_name(version)}")) if version else {}


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(PARTS)).cast("int")


def read(spark: SparkSession, path: str, version: int | None = None, *, key_is: tuple[str, str] | None = None) -> DataFrame | None:
    """The rows of a version (the newest by default), or None of the empty table; of one key (column, value) only its partition."""
    _, folders = manifest(spark, path, version)
    if key_is is not None:
        part = spark.range(1).select(_part(F.lit(key_is[1]))).first()[0]
        folders = {k: v for k, v in folders.items() if k == str(part)}
    if not folders:
        return None
    rows = spark.read.parquet(*[f"{path}/data/{folder}/part={k}" for k, folder in sorted(folders.items())])
    return rows if key_is is None else rows.where(F.col(key_is[0]).cast("string") == key_is[1])


def replace(new: DataFrame, path: str, key: str, *, gone: DataFrame | None = None) -> int:
    """Puts `new` in place of all earlier rows of its keys, drops the keys of `gone`, and returns the version that holds it.

    Only partitions with one of these keys are written. Without any change nothing is written and the
    version stays. Raises Conflict when another writer published meanwhile; the run may then be repeated.
    """
    spark = new.sparkSession
    version, folders = manifest(spark, path)
    folder = uuid.uuid4().hex
    _stage(new.withColumn("part", _part(F.col(key))), f"{path}/data/{folder}-new")
    staged = spark.read.schema(new.withColumn("part", F.lit(0)).schema).parquet(f"{path}/data/{folder}-new")
    keys = staged.select(key, "part")
    if gone is not None:
        keys = keys.unionByName(gone.select(key, _part(F.col(key)).alias("part")))
    touched = sorted(r["part"] for r in keys.select("part").distinct().collect())  # at most PARTS
    every = staged
    old = [f"{path}/data/{folders[str(k)]}/part={k}" for k in touched if str(k) in folders]
    if old:
        before = spark.read.schema(new.schema).parquet(*old)
        every = before.join(keys.select(key).distinct(), key, "left_anti").withColumn("part", _part(F.col(key))).unionByName(staged)
    if touched:
        _stage(every, f"{path}/data/{folder}")
    there = _folders(spark, f"{path}/data/{folder}") if touched else set()
    now = {k: v for k, v in folders.items() if int(k) not in touched} | {str(k): folder for k in touched if k in there}
    fs, aside = _fs(spark, f"{path}/data/{folder}-new")
    fs.delete(aside, True)
    if now == folders:
        return version
    _create(spark, f"{path}/manifests/{_name(version + 1)}", json.dumps(now, sort_keys=True))
    return version + 1


def _stage(rows: DataFrame, path: str) -> None:
    rows.repartition("part").write.partitionBy("part").parquet(path)


def _folders(spark: SparkSession, path: str) -> set[int]:
    fs, p = _fs(spark, path)
    return {int(s.getPath().getName()[5:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("part=")}


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> None:
    """Deletes the data that the newest `keep` versions do not name, and the manifests before them. Runs that still write must be over."""
    found = versions(spark, path)
    used = {f for v in found[-keep:] for f in manifest(spark, path, v)[1].values()}
    fs, p = _fs(spark, f"{path}/data")
    for s in fs.listStatus(p):
        if s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)
    for v in found[:-keep]:
        fs.delete(_fs(spark, f"{path}/manifests/{_name(v)}")[1], False)


def lease(spark: SparkSession, path: str, work: str, worker: str, seconds: float, *, now: float | None = None) -> None:
    """Takes a piece of work for some time; raises Conflict while another worker holds it. A lease that ran out may be taken."""
    now = time.time() if now is None else now
    file = f"{path}/leases/{work}"
    fs, p = _fs(spark, file)
    if fs.exists(p):
        held = json.loads(_text(spark, file))
        if held["worker"] != worker and held["until"] > now:
            raise Conflict(f"{work} is held by {held['worker']}")
        fs.delete(p, False)
    _create(spark, file, json.dumps({"worker": worker, "until": now + seconds}))


def release(spark: SparkSession, path: str, work: str) -> None:
    fs, p = _fs(spark, f"{path}/leases/{work}")
    fs.delete(p, False)
