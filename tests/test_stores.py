"""Snapshots that survive failing writes, and differences of stores by their digests."""

import pytest
from pyspark.sql import functions as F

from carepath.operators import digests
from carepath.sources import snapshots as sn


def table(spark, rows):
    return spark.createDataFrame(rows, "patient string, n int")


def content(df):
    return sorted(tuple(r)[:2] for r in df.select("patient", "n").collect()) if df is not None else []


def test_versions_are_whole_and_pinned(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sn.read(spark, path) is None
    assert sn.replace(table(spark, [(f"p{k}", k) for k in range(200)]), path, "patient") == 1
    assert sn.replace(table(spark, [("p3", 30), ("p3", 31), ("new", 1)]), path, "patient", gone=table(spark, [("p5", 0), ("nobody", 0)])) == 2
    want = sorted([(f"p{k}", k) for k in range(200) if k not in (3, 5)] + [("p3", 30), ("p3", 31), ("new", 1)])
    assert content(sn.read(spark, path)) == want
    assert content(sn.read(spark, path, 1)) == sorted((f"p{k}", k) for k in range(200))
    assert content(sn.read(spark, path, key_is=("patient", "p3"))) == [("p3", 30), ("p3", 31)]
    old, new = (sn.manifest(spark, path, v)[1] for v in (1, 2))
    assert 1 <= sum(old.get(k) != v for k, v in new.items()) <= 4  # the others' files are shared
    assert sn.replace(table(spark, []), path, "patient") == 2  # nothing to do, nothing published
    sn.vacuum(spark, path, keep=1)
    assert sn.versions(spark, path) == [2] and content(sn.read(spark, path)) == want


def test_a_run_that_dies_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sn.replace(table(spark, [(f"p{k}", k) for k in range(50)]), path, "patient")
    before, write = content(sn.read(spark, path)), sn._stage
    for dies_at in (1, 2):
        calls = []

        def failing(rows, where):
            calls.append(where)
            if len(calls) == dies_at:
                write(rows.where("part % 2 = 0"), where)  # some partitions are there, then the run dies
                raise OSError("gone")
            write(rows, where)

        monkeypatch.setattr(sn, "_stage", failing)
        with pytest.raises(OSError):
            sn.replace(table(spark, [(f"p{k}", -k) for k in range(50)]), path, "patient")
        assert content(sn.read(spark, path)) == before and sn.versions(spark, path) == [1]
    monkeypatch.setattr(sn, "_stage", write)
    assert sn.replace(table(spark, [(f"p{k}", -k) for k in range(50)]), path, "patient") == 2
    assert content(sn.read(spark, path)) == sorted((f"p{k}", -k) for k in range(50))


def test_the_second_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sn.replace(table(spark, [("a", 1)]), path, "patient")
    real = sn._create

    def overtaken(s, where, text):
        if where.endswith(sn._name(2)):
            monkeypatch.setattr(sn, "_create", real)
            sn.replace(table(spark, [("b", 2)]), path, "patient")
        real(s, where, text)

    monkeypatch.setattr(sn, "_create", overtaken)
    with pytest.raises(sn.Conflict):
        sn.replace(table(spark, [("a", 9)]), path, "patient")
    assert content(sn.read(spark, path)) == [("a", 1), ("b", 2)]
    assert sn.replace(table(spark, [("a", 9)]), path, "patient") == 3


def test_leases(spark, tmp_path):
    path = str(tmp_path / "t")
    sn.lease(spark, path, "w1", "ann", 60, now=100.0)
    sn.lease(spark, path, "w1", "ann", 60, now=110.0)
    with pytest.raises(sn.Conflict):
        sn.lease(spark, path, "w1", "bob", 60, now=120.0)
    sn.lease(spark, path, "w1", "bob", 60, now=171.0)
    sn.release(spark, path, "w1")
    sn.lease(spark, path, "w1", "ann", 60, now=172.0)


def test_changed_patients_and_the_files_read(spark, tmp_path):
    rows = spark.range(3000).select((F.col("id") % 1000).cast("string").alias("patient"), (F.col("id") / 1000).cast("int").alias("seq"), (F.col("id") * 7).cast("string").alias("v"))
    later = rows.where("patient <> '17'").withColumn("v", F.when((F.col("patient") == "5") & (F.col("seq") == 1), None).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("new", 0, "x")], "patient string, seq int, v string"))
    for name, df in (("a", rows), ("same", rows.repartition(7)), ("b", later)):
        digests.save_tree(digests.patient_digests(df, "patient", ["seq"], ["seq", "v"]), str(tmp_path / name), "patient", parts=8, branches=16)
    a, same, b = (str(tmp_path / x) for x in ("a", "same", "b"))
    assert digests.root(spark, a) == digests.root(spark, same) != digests.root(spark, b)
    assert digests.changed(spark, a, same, "patient").count() == 0
    found = digests.changed(spark, a, b, "patient")
    assert {(r.patient, r.what) for r in found.collect()} == {("17", "removed"), ("5", "changed"), ("new", "added")}
    read = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in read
    metrics = [int(x) for x in _files_read(found)]
    assert sum(metrics) <= 6  # three branches of each tree, of 128


def _files_read(df):
    """The files that the scans of a plan select."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    leaves = plan.collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        inner = leaf.plan().collectLeaves() if "Stage" in leaf.nodeName() else None
        for x in [inner.apply(j) for j in range(inner.size())] if inner is not None else [leaf]:
            if "Scan" in x.nodeName():
                out.append(x.metrics().apply("numFiles").value())
    return out
