"""Generic operators on any table: runs, latest rows, as-of look-ups, interval joins, ranks and digests.

The clinical layer is a composition of these. All take key columns and orders as parameters.
What is per key (a last break, a latest row) is found by grouping, which combines before the
shuffle, rather than by a window, so a key with very many rows does not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of key columns, for keys that may be null."""
    out = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        out &= left[k].eqNullSafe(right[k])
    return out


def run_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], abnormal: Column) -> DataFrame:
    """The rows of the abnormal run that ends at each key's latest row; a null `abnormal` breaks a run."""
    marked = df.withColumn("__at", F.struct(*order)).withColumn("__abnormal", F.coalesce(abnormal, F.lit(False)))
    breaks = marked.where(~F.col("__abnormal")).groupBy(*keys).agg(F.max("__at").alias("__break"))
    after = marked.where("__abnormal").join(breaks, list(keys), "left").where("__break is null or __at > __break")
    return after.drop("__at", "__abnormal", "__break")


def trailing_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], abnormal: Column, day: Column, *, least: int = 2, span_days: int = 90) -> DataFrame:
    """The run of abnormal rows that ends at each key's latest row: n, first_day, last_day, span, persistent.

    A key whose latest row is not abnormal has no run and no row here. A null `abnormal` breaks a run.
    """
    rows = df.select(*keys, *[c for c in order if c not in keys], abnormal.alias("__is"), day.alias("__day"))
    after = run_rows(rows, keys, order, F.col("__is"))
    span = F.date_diff(F.max("__day"), F.min("__day"))
    out = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__day").alias("first_day"), F.max("__day").alias("last_day"), span.cast("long").alias("span"))
    return out.withColumn("persistent", (F.col("n") >= least) & (F.col("span") >= span_days))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], *columns: str) -> DataFrame:
    """The given columns of each key's last row in `order`, which should end in an id."""
    best = F.max(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in columns])).alias("__last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__last.__{c}").alias(c) for c in columns])


def precedes(df: DataFrame, keys: Sequence[str], order: Sequence[str], node: str) -> DataFrame:
    """(keys, src, dst): each row's node and the next one's of the same key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(*keys, F.col(node).alias("src"), F.lead(node).over(w).alias("dst")).where("dst is not null")


def evidence_picks(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, node: str, *, days: int = 90) -> DataFrame:
    """first, later (the first at least `days` after it) and latest node of each key."""
    at = F.struct(*order, F.col(day).alias("__d"), F.col(node).alias("__n"))
    ends = df.groupBy(*keys).agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    far = df.withColumn("__at", at).join(ends.select(*keys, F.col("__first.__d").alias("__from")), list(keys)).where(F.date_diff(F.col(day), "__from") >= days)
    later = far.groupBy(*keys).agg(F.min("__at").alias("__later"))
    return ends.join(later, list(keys), "left").select(*keys, F.col("__first.__n").alias("first"), F.col("__later.__n").alias("later"), F.col("__last.__n").alias("latest"))


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: str, right_order: Sequence[str], value: str) -> DataFrame:
    """Left rows with the `value` of the last right row of the same keys at or before them (null for none).

    One shuffle: both sides in one window, right rows first at equal times.
    """
    l_row = F.struct(*[F.col(c) for c in left.columns])
    r_all = right.select(*keys, F.col(right_order[0]).alias("__t"), F.lit(0).alias("__side"), F.struct(*right_order, F.col(value).alias("__v")).alias("__r"), F.lit(None).cast(left.select(l_row.alias("x")).schema["x"].dataType).alias("__l"))
    l_all = left.select(*keys, F.col(left_order).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r_all.schema["__r"].dataType).alias("__r"), l_row.alias("__l"))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = r_all.unionByName(l_all).withColumn("__best", F.max("__r").over(w))
    return both.where("__side = 1").select("__l.*", F.col("__best.__v").alias(f"asof_{value}"))


def overdue(subjects: DataFrame, tests: DataFrame, key: str, day: str, *, as_of: Column, months: int) -> DataFrame:
    """Each subject's last test day and whether it is due: none, or before the same day `months` earlier."""
    last = tests.where(F.col(day) <= as_of).groupBy(key).agg(F.max(day).alias("last_test"))
    return subjects.join(last, key, "left").withColumn("due", F.col("last_test").isNull() | (F.col("last_test") < F.add_months(as_of, -months)))


def within(df: DataFrame, other: DataFrame, keys: Sequence[str], condition: Column, *, there: bool) -> DataFrame:
    """Rows of `df` (aliased l) for which `other` (aliased r) has, or has not, a row of the same keys that meets the condition."""
    on = condition
    for k in keys:
        on &= F.col(f"l.{k}") == F.col(f"r.{k}")
    return df.alias("l").join(other.alias("r"), on, "left_semi" if there else "left_anti")


def near(df: DataFrame, other: DataFrame, keys: Sequence[str], at: Column, other_at: Column, low: int, high: int, *, there: bool) -> DataFrame:
    """Rows of `df` for which `other` has, or has not, a row of the same keys at a whole number from at + low to at + high.

    Numbers fall in bins as wide as the interval, which so meets two of them at most: of the first the
    greatest number decides, of the next the least. These are kept for each bin, so the work grows with
    the rows and not with the pairs, and a key with any share of them falls in as many bins as it spans.
    Null keys and places meet nothing.
    """
    width = high - low + 1
    bin_of = lambda x: F.floor(x / F.lit(width)).cast("long")
    rows = other.select(*keys, other_at.cast("long").alias("__v"))
    none = F.lit(None).cast("long")
    own = rows.select(*keys, bin_of(F.col("__v")).alias("__bin"), F.col("__v").alias("__own"), none.alias("__next"))
    following = rows.select(*keys, (bin_of(F.col("__v")) - 1).alias("__bin"), none.alias("__own"), F.col("__v").alias("__next"))
    ends = own.unionByName(following).groupBy(*keys, "__bin").agg(F.max("__own").alias("__own"), F.min("__next").alias("__next"))
    asked = df.withColumn("__from", at.cast("long") + low).withColumn("__bin", bin_of(F.col("__from")))
    met = (F.col("__own") >= F.col("__from")) | (F.col("__next") <= F.col("__from") + (width - 1))
    found = asked.join(ends, [*keys, "__bin"], "left").withColumn("__met", F.coalesce(met, F.lit(False)))
    return found.where(F.col("__met") if there else ~F.col("__met")).select(*[found[c] for c in df.columns])


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str, right_value: str, width: str) -> DataFrame:
    """All columns of the pairs of the same keys whose values differ by at most the left row's `width`.

    Values fall in bins of the power of two at or above the width; a left row looks into its bin and the
    two beside it, a right row lies in one bin for each width in use, so a pair meets once. Other column
    names must differ. A null, a negative width and a null key meet nothing.
    """
    size = F.abs(F.col(left_value).cast("double"))
    level = F.greatest(F.when(F.col(width) > 0, F.ceil(F.log2(width))), F.when(size > 0, F.floor(F.log2(size)) - 50), F.lit(-1000)).cast("int")  # bins that doubles tell apart
    asked = left.where(F.col(width) >= 0).withColumn("__e", level)
    levels = sorted(r["__e"] for r in asked.select("__e").distinct().collect())  # at most the exponents of doubles
    bin_of = lambda v: F.floor(F.col(v).cast("double") / F.pow(F.lit(2.0), F.col("__e").cast("double"))).cast("double")  # noqa: E731  exact in doubles
    asked = asked.withColumn("__bin", F.explode(F.array(*[bin_of(left_value) + F.lit(float(k)) for k in (-1, 0, 1)])))
    held = right.withColumn("__e", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("__bin", bin_of(right_value))
    near_ = F.abs(F.col(left_value).cast("double") - F.col(right_value).cast("double")) <= F.col(width)
    return asked.join(held, [*keys, "__e", "__bin"]).where(near_).drop("__e", "__bin")


def kth_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], left_value: str, right_value: str) -> DataFrame:
    """k-th left row with the k-th right row of each key; what has no partner keeps a null."""
    number = lambda order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    a = left.select(*keys, number(left_order).alias("k"), F.col(left_value).alias("left_value"))
    b = right.select(*keys, number(right_order).alias("k"), F.col(right_value).alias("right_value"))
    return a.join(b, [*keys, "k"], "full")


def most_frequent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each key's most frequent value, ties by the value, and how often it occurs."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("__less"), F.col(value).alias("__v"))).alias("__b")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("__b.__v").alias(value), (-F.col("__b.__less")).alias("n"))


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], *, cells: int = 4096) -> DataFrame:
    """Exact order statistics at place round(q * (n - 1)), halves to even, of each key.

    Values are counted in equal ranges between a key's least and greatest; only the ranges that
    hold a wanted place are ordered, so a key with very many rows is never sorted in one task.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    ends = rows.groupBy(*keys).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    part = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * cells), F.lit(cells - 1))).otherwise(0)
    celled = rows.join(ends, list(keys)).withColumn("__c", part.cast("int"))
    counts = celled.groupBy(*keys, "__n", "__c").agg(F.count(F.lit(1)).alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*keys).orderBy("__c")) - F.col("__m")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()]))
    places = counts.withColumn("__before", before).select(*keys, "__c", "__before", "__m", "__n", wanted.alias("__q"))
    places = places.withColumn("__place", F.bround(F.col("__q.q") * (F.col("__n") - 1), 0).cast("long")).where("__place >= __before and __place < __before + __m")
    rank = F.row_number().over(Window.partitionBy(*keys, "__c").orderBy("__v")) - 1
    some = celled.select(*keys, "__c", "__v").join(places.select(*keys, "__c", "__before").distinct(), [*keys, "__c"])
    ranked = some.withColumn("__place", F.col("__before") + rank).select(*keys, "__place", "__v")
    found = ranked.join(places.select(*keys, "__place", F.col("__q.name").alias("__name")), [*keys, "__place"])
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in quantiles])


def ordered_digest(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: Column, *, glue: str = "\n") -> DataFrame:
    """SHA-256 over the texts of each key's rows in order."""
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("__t"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(rows, lambda r: r["__t"]), glue), 256).alias("digest"))


def hash_share(key: Column) -> Column:
    """The first byte of a key's SHA-256, as a share of 256."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int") / 256


def seeded_sample(df: DataFrame, keys: Sequence[str], node: str, seed: str, n: int) -> DataFrame:
    """n rows of each key in the order of a hash of (seed, node); bounded for each key at any size of the table."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(node).cast("string")), 256)
    salted = df.withColumn("__h", h).withColumn("__salt", F.pmod(F.xxhash64(node), F.lit(64)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__h", node))
    few = salted.withColumn("__r", rank(*keys, "__salt")).where(F.col("__r") <= n)
    return few.withColumn("place", rank(*keys)).where(F.col("place") <= n).drop("__h", "__salt", "__r")


def floor_ranks(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the values at place floor(share * (n - 1)) of its values in order.

    Equal values are counted first, so a hot key is a running sum over its distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("m"))
    upto = Window.partitionBy(*keys).orderBy("v")
    ranked = counts.withColumn("end", F.sum("m").over(upto)).withColumn("n", F.sum("m").over(Window.partitionBy(*keys)))
    here = lambda share: (F.floor(F.lit(share) * (F.col("n") - 1)) >= F.col("end") - F.col("m")) & (F.floor(F.lit(share) * (F.col("n") - 1)) < F.col("end"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(here(share), F.col("v"))).alias(name) for name, share in shares.items()])


def unordered_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, digest and n: a sum of 48-bit row digests, combined before the shuffle and equal for any order of the rows."""
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.sum(row).cast("decimal(38,0)").alias("digest"), F.count(F.lit(1)).alias("n"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], *columns: str) -> DataFrame:
    """The columns of each key's first row in order, by an aggregate."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*columns).alias("row"))).alias("first")).select(*keys, "first.row.*")


def episode_start(df: DataFrame, keys: Sequence[str], day: str, *, gap: int) -> DataFrame:
    """since and last_day: where the latest run of days without a gap of more than `gap` days begins; days are counted once."""
    days = df.where(F.col(day).isNotNull()).select(*keys, F.col(day).alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy(*keys).orderBy("day"))
    fresh = before.isNull() | (F.date_diff(F.col("day"), before) > gap)
    return days.withColumn("fresh", fresh).groupBy(*keys).agg(F.max(F.when(F.col("fresh"), F.col("day"))).alias("since"), F.max("day").alias("last_day"))


def set_differences(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two sets has, as what: missing (expected only) or extra."""
    here = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f")))
    both = here.groupBy(*keys).agg(F.max("e").alias("e"), F.max("f").alias("f")).where("e <> f")
    return both.select(*keys, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("what"))
