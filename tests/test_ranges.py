"""Joins by bins and resampled intervals against brute force, and a key that holds all rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from carepath.operators import core, evaluation


@pytest.mark.parametrize(("low", "high"), [(-90, -1), (1, 30), (0, 0), (-3, 4), (-10, -5)])
def test_near_against_brute_force(spark, low, high):
    r = random.Random(low * 100 + high)
    a = [(k, r.choice(["x", "y", None]), r.choice([None, *range(-40, 400, 3)])) for k in range(120)]
    b = [(r.choice(["x", "y", None]), r.choice([None, *range(-60, 500, 7)])) for _ in range(40)]
    want = {k for k, key, v in a if any(key is not None and key == q and v is not None and w is not None and v + low <= w <= v + high for q, w in b)}
    left, right = spark.createDataFrame(a, "k int, key string, v int"), spark.createDataFrame(b, "key string, w int")
    for there in (True, False):
        got = [row.k for row in core.near(left, right, ["key"], F.col("v"), F.col("w"), low, high, there=there).collect()]
        assert len(got) == len(set(got)) and set(got) == (want if there else {k for k, *_ in a} - want)


def test_band_pairs_against_brute_force(spark):
    r = random.Random(2)
    a = [(k, r.choice("xy"), r.choice([None, r.uniform(-50, 50), 4.0, -8.0]), r.choice([None, 0.0, -1.0, 0.5, 1.0, 3.7, 16.0])) for k in range(150)]
    b = [(k, r.choice("xyz"), r.choice([None, r.uniform(-50, 50), 4.0, 5.0, -9.0])) for k in range(150)]
    want = sorted((i, j) for i, p, v, w in a for j, q, u in b if p == q and None not in (v, w, u) and w >= 0 and abs(v - u) <= w)
    got = core.band_pairs(spark.createDataFrame(a, "i int, key string, v double, w double"), spark.createDataFrame(b, "j int, key string, u double"), ["key"], "v", "u", "w")
    assert sorted((r.i, r.j) for r in got.collect()) == want and want


def test_a_key_that_holds_all_rows_stays_linear(spark):
    """All pairs would be 9e10; values are spread, so bins hold a few rows each."""
    rows = spark.range(300_000).select(F.lit("hot").alias("key"), (F.col("id") * 2).alias("v"))
    assert core.near(rows, rows, ["key"], F.col("v"), F.col("v"), 1, 2, there=True).count() == 299_999
    left = rows.withColumn("w", F.lit(1.0))
    assert core.band_pairs(left, rows.withColumnRenamed("v", "u"), ["key"], "v", "u", "w").count() == 300_000


def poisson(cluster, r, seed):
    u = int(hashlib.md5(f"{seed}|{cluster}|{r}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= p for p in evaluation.POISSON)


def test_bootstrap_against_brute_force(spark):
    r = random.Random(3)
    rows = [(g, f"c{r.randrange(9)}" if r.random() < 0.95 else None, r.randint(0, 3), r.randint(3, 5)) for g in "ab" for _ in range(60)]
    rows += [("none", "c", 0, 4), ("none", "d", 0, 3), ("all", "c", 4, 4), ("empty", "c", 0, 0)]
    df = spark.createDataFrame(rows, "g string, c string, k int, n int")
    got = {x.g: x for x in evaluation.bootstrap(df, ["g"], "c", F.col("k"), F.col("n"), replicates=150, seed="s").collect()}
    for g in "ab":
        clusters = {}
        for h, c, k, n in rows:
            if h == g:
                a, b = clusters.get(c or "", (0, 0))
                clusters[c or ""] = a + k, b + n
        values = []
        for rep in range(150):
            w = {c: poisson(c, rep, "s") for c in clusters}
            den = sum(w[c] * n for c, (_, n) in clusters.items())
            if den:
                values.append(sum(w[c] * k for c, (k, _) in clusters.items()) / den)
        values.sort()
        x = got[g]
        assert (x.low, x.high) == (values[int(0.025 * (len(values) - 1))], values[int(0.975 * (len(values) - 1))]) and not x.exact
        assert x.low < x.estimate < x.high
    assert (got["none"].low, got["none"].exact) == (0.0, True) and got["none"].high == pytest.approx(1 - 0.025 ** (1 / 7))
    assert got["all"].high == 1.0 and got["all"].low == pytest.approx(0.025 ** (1 / 4))
    assert (got["empty"].estimate, got["empty"].low, got["empty"].exact) == (None, None, None)
    assert evaluation.bootstrap(df.where("g = 'a'"), [], "c", F.col("k"), F.col("n"), replicates=150, seed="s").first().low == got["a"].low


def test_weights_are_poisson(spark):
    n = [r.w for r in spark.range(20_000).select(evaluation.resample_weight(F.col("id"), F.lit(1), "x").alias("w")).collect()]
    assert sum(n) / len(n) == pytest.approx(1, abs=0.03) and sum(x * x for x in n) / len(n) == pytest.approx(2, abs=0.08)


def test_bootstrap_hashes_once_and_deals_clusters_to_all_cores(spark):
    df = spark.createDataFrame([("a", c, c % 3, 3) for c in range(50)] + [("none", 1, 0, 0)], "g string, c int, k int, n int")
    out = evaluation.bootstrap(df, ["g"], "c", F.col("k"), F.col("n"), replicates=40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "RepartitionByExpression" in plan
    got = {r.g: r for r in out.collect()}
    assert got["none"].n == 0 and got["none"].low is None and got["a"].n == 150 and got["a"].low < got["a"].estimate < got["a"].high
