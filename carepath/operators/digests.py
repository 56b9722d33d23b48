"""A tree of digests over a store's patients, and the difference of two trees.

A patient's digest is over its rows in order. Patients are dealt to a number of branches in each of
a number of parts by a hash of their key; a branch's digest is over its patients, a part's over its
branches. Two trees are compared from the top: only branches whose digests differ are read, so
the files read grow with what changed and not with the store.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS, BRANCHES = 64, 64


def _place(key: Column, parts: int, branches: int) -> tuple[Column, Column]:
    h = F.xxhash64(key.cast("string"))
    return F.pmod(h, F.lit(parts)).cast("int"), F.pmod(F.shiftright(h, 8), F.lit(branches)).cast("int")


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of columns as text, each with its length; null is told from the empty text."""
    parts = [F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def patient_digests(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """key, digest and n: over the digests of a patient's rows in order (64 bytes a row meet in one row of the result)."""
    each = rows.select(key, F.struct(*order, row_digest(columns).alias("__d")).alias("__r"))
    listed = each.groupBy(key).agg(F.sort_array(F.collect_list("__r")).alias("__rs"))
    return listed.select(key, F.sha2(F.array_join(F.transform("__rs", lambda r: r["__d"]), ""), 256).alias("digest"), F.size("__rs").alias("n"))


def _over(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """The digest of each group's members, by the members in order."""
    line = F.concat_ws(" ", F.col(order).cast("string"), F.col("digest"))
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


def save_tree(digests: DataFrame, path: str, key: str, *, parts: int = PARTS, branches: int = BRANCHES) -> None:
    """Writes the tree of a store: its patients by part and branch, and the digests of branches and parts. Trees to compare need the same shape."""
    part, branch = _place(F.col(key), parts, branches)
    placed = digests.withColumn("part", part).withColumn("branch", branch)
    placed.repartition("part", "branch").write.partitionBy("part", "branch").parquet(f"{path}/patients")
    spark = digests.sparkSession
    over = _over(spark.read.schema(placed.schema).parquet(f"{path}/patients"), ["part", "branch"], key)
    over.repartition("part").write.partitionBy("part").parquet(f"{path}/branches")
    schema = "branch int, digest string, part int"
    _over(spark.read.schema(schema).parquet(f"{path}/branches"), ["part"], "branch").coalesce(1).write.parquet(f"{path}/parts")


def root(spark: SparkSession, path: str) -> str:
    """One digest for the whole store."""
    return _over(spark.read.parquet(f"{path}/parts").withColumn("one", F.lit(1)), ["one"], "part").select("digest").union(spark.range(1).select(F.sha2(F.lit(""), 256))).first()[0]


def _unlike(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = (df.select(*keys, F.col("digest").alias(name)) for df, name in ((old, "__a"), (new, "__b")))
    return a.join(b, list(keys), "full").where(~F.col("__a").eqNullSafe(F.col("__b")))


def changed(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """key and what (added, changed or removed) of the patients that differ between two saved trees."""
    read = lambda path, level: spark.read.parquet(f"{path}/{level}")
    parts = [r["part"] for r in _unlike(read(old, "parts"), read(new, "parts"), ["part"]).collect()]  # at most PARTS
    some = lambda df: df.where(F.col("part").isin(parts))
    branches = _unlike(some(read(old, "branches")), some(read(new, "branches")), ["part", "branch"]).select("part", "branch").collect()  # at most PARTS x BRANCHES
    by_part: dict[int, list[int]] = {}
    for r in branches:
        by_part.setdefault(r["part"], []).append(r["branch"])
    here = F.lit(False)
    for part, found in by_part.items():
        here |= (F.col("part") == part) & F.col("branch").isin(found)
    rows = _unlike(read(old, "patients").where(here), read(new, "patients").where(here), [key])
    return rows.select(key, F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed").alias("what"))
