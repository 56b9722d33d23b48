"""Scores of extraction and retrieval, shares with exact intervals, and choices of labels."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ratio(num: Column, den: Column) -> Column:
    """A share; null without a denominator."""
    return F.try_divide(num.cast("double"), den)


def close(a: Column, b: Column) -> Column:
    """Equal to nine digits or 1e-9, whichever is wider."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(b))


def scores(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Recall, precision and exact values of paired rows (truth_value, predicted_value; null where unpaired), whole or by group."""
    truth, predicted = F.col("truth_value").isNotNull(), F.col("predicted_value").isNotNull()
    n = F.count_if
    counts = pairs.groupBy(*by).agg(n(truth).alias("n_truth"), n(predicted).alias("n_predicted"), n(truth & predicted).alias("n_paired"), n(truth & predicted & close(F.col("predicted_value"), F.col("truth_value"))).alias("n_exact"))
    return counts.withColumn("recall", ratio(F.col("n_paired"), F.col("n_truth"))).withColumn("precision", ratio(F.col("n_paired"), F.col("n_predicted"))).withColumn("exact", ratio(F.col("n_exact"), F.col("n_paired")))


def recall_at(ranked: DataFrame, expected: Column, query: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Over queries: the share whose first expected hit is among the first k."""
    first = ranked.groupBy(query).agg(F.min(F.when(expected, F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("n"), *[ratio(F.count_if(F.col("first") <= k), F.count(F.lit(1))).alias(f"at_{k}") for k in ks])


def exact_interval(successes: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson bounds of a share, by bisection of the binomial tails."""
    tail = lambda p, ks: sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in ks)
    half = (1 - level) / 2

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return lo

    low = 0.0 if successes == 0 else solve(lambda p: tail(p, range(successes, n + 1)) < half)
    high = 1.0 if successes == n else solve(lambda p: tail(p, range(successes + 1)) > half)
    return low, high


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402)


def resample_weight(cluster: Column, replicate: Column, seed: str) -> Column:
    """How often a replicate takes a cluster: a Poisson number of mean 1 (at most 9) from a hash of the three."""
    return _poisson(_drawn(cluster, replicate, seed))


def _drawn(cluster: Column, replicate: Column, seed: str) -> Column:
    """Eight hexadecimal digits from a hash of the three."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), cluster.cast("string"), replicate.cast("string"))), 1, 8)


def _poisson(drawn: Column) -> Column:
    """The Poisson number at the place among all digits where the drawn ones stand: digits compare as their numbers do."""
    least = [f"{ceil(p * (1 << 32)):08x}" for p in POISSON]  # of the first digits that reach a chance
    out = F.when(drawn < least[0], 0)
    for k, digits in enumerate(least[1:], 1):
        out = out.when(drawn < digits, k)
    return out.otherwise(len(least))


def bootstrap(rows: DataFrame, by: Sequence[str], cluster: str, num: Column, den: Column, *, replicates: int = 1000, seed: str = "bootstrap", level: float = 0.95) -> DataFrame:
    """by, n, estimate, low, high and exact: the interval of sum(num) / sum(den), whole clusters resampled.

    Rows are summed for each cluster once, and the clusters are dealt to all cores, as each becomes a row
    for every replicate. A replicate takes each cluster a hashed Poisson number of times, so its sums are
    plain sums, combined before the shuffle and the same in any order; replicate -1 takes every cluster once. The interval lies between the replicates' values at the floor of the outer places. At 0 and
    at 1 all replicates agree, and the exact bound of a share takes the place of the interval. A group
    without a denominator has null values; a null cluster is a cluster.
    """
    sums = rows.groupBy(*by, F.col(cluster).alias("__c")).agg(F.coalesce(F.sum(num), F.lit(0)).alias("__k"), F.coalesce(F.sum(den), F.lit(0)).alias("__n"))
    spark = rows.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = F.coalesce(F.col("__c").cast("string"), F.lit(""))
    drawn = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: _drawn(name, r, seed))
    each = sums.repartition(parts, *by, "__c").select(*by, "__k", "__n", F.posexplode(F.concat(F.array(F.lit("")), drawn)).alias("__r", "__d"))  # of replicate r - 1
    weight = F.when(F.col("__r") == 0, 1).otherwise(_poisson(F.col("__d")))
    taken = each.select(*by, "__r", "__k", "__n", weight.alias("__w")).groupBy(*by, "__r").agg(F.sum(F.col("__w") * F.col("__k")).alias("__k"), F.sum(F.col("__w") * F.col("__n")).alias("__n"))
    of_all = lambda c: F.max(F.when(F.col("__r") == 0, F.col(c)))
    share = F.when((F.col("__r") > 0) & (F.col("__n") > 0), F.col("__k").cast("double") / F.col("__n"))
    out = taken.groupBy(*by).agg(of_all("__k").alias("k"), of_all("__n").alias("n"), F.sort_array(F.collect_list(share)).alias("__v"))  # `replicates` at most
    half = (1 - level) / 2
    place = lambda q: F.get("__v", F.floor(F.lit(q) * (F.size("__v") - 1)).cast("int"))
    tail = F.pow(F.lit(half), 1 / F.col("n"))
    edge = (F.col("k") == 0) | (F.col("k") == F.col("n"))
    some = lambda c: F.when(F.col("n") > 0, c)
    low = F.when(F.col("k") == 0, 0.0).when(F.col("k") == F.col("n"), tail).otherwise(place(half))
    high = F.when(F.col("k") == 0, 1 - tail).when(F.col("k") == F.col("n"), 1.0).otherwise(place(1 - half))
    return out.select(*by, "n", ratio(F.col("k"), F.col("n")).alias("estimate"), some(low).alias("low"), some(high).alias("high"), some(edge).alias("exact"))


# Tiers of label types, best first.
TIERS = {"C73594": 0, "C73585": 0, "C73584": 1, "C73605": 1}


def label_choice(listings: DataFrame) -> DataFrame:
    """One label of each drug (rxcui): the best tier, then newest, then higher version, then lower set id; and the candidates of its tier."""
    table = F.create_map(*[F.lit(x) for p in TIERS.items() for x in p])
    tiered = listings.withColumn("tier", F.coalesce(F.try_element_at(table, F.col("type")), F.lit(2)))
    order = Window.partitionBy("rxcui").orderBy("tier", F.desc("published"), F.desc("version"), "set_id")
    counts = tiered.groupBy("rxcui", "tier").agg(F.count(F.lit(1)).alias("candidates"))
    return tiered.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r").join(counts, ["rxcui", "tier"])


def newest(notes: DataFrame, key: str, day: str, node: str, n: int = 3) -> DataFrame:
    """The newest n rows of each key."""
    return notes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day), F.desc(node)))).where(F.col("r") <= n).drop("r")


def quote_problem(quote: Column, note: Column, terms: str) -> Column:
    """Why a quote of a note is not kept: too long, not verbatim, or off the topic; null when it is kept."""
    squash = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(F.size(F.split(F.trim(quote), r"\s+")) > 40, "too long").when(~F.contains(squash(note), squash(quote)), "not verbatim").when(~F.lower(quote).rlike(terms), "off topic")


def rule_totals(assessed: DataFrame, keys: Sequence[str] = ("rule",)) -> DataFrame:
    """keys, met, not_met and not_assessable of a table of statuses."""
    return assessed.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("met", "not_met", "not_assessable")])
