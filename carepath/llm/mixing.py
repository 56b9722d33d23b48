"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Each source has a target number of words. Whole epochs of a source come first; what then is
left is filled by rows in the order of their exponential keys -ln(u)/w, where u is a hash of
the row's id, text and number among rows alike in both, and w its quality, until the running sum of sizes meets the budget. The sum is
taken in two steps: over ranges of the keys (small sums, a window for each source), then over
the rows of the one range of each source in which the budget ends. A source of n rows has about
sqrt(n) ranges of as many rows, so no source, however large, is ever sorted in one task. The
outcome for a source is a cut (range, key, id), and applying the cuts is a join with one row for
each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from carepath.llm.common import discard, stored

#: Weights of the sources in code point order, repeating; times a source may be taken.
WEIGHTS, MOST_EPOCHS = (5.0, 2.0, 1.0), 3
#: Sources up to which their totals pass through the driver and their cuts are broadcast; of more, both stay tables.
DRIVER_SOURCES = 100_000
SEED = 20_240_229


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The weight of a document unless another is given: 0.5 to 1, less the more of its characters are markup symbols."""
    marks = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    share = F.least(F.lit(1.0), 8.0 * marks / F.greatest(F.length(text), F.lit(1)))
    return F.coalesce(1.0 - 0.5 * share, F.lit(1.0))


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """The words to take from each source: all sizes together, shared by weight; what is above `most` sizes is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and share * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: share * weight[s] for s in order if s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


def target_table(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The same targets beside a stored table of any number of sources (source, source_size, rows).

    The places of the sources in code point order are taken from a range partitioning; the share is
    found by one aggregate a step, as the sources that are full only grow.
    """
    parts = totals.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    parts = stored(parts.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("within")), "mix-order")
    before, at = 0, []
    for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # one row for each partition
        at.append((r["part"], before))
        before += r["n"]
    place = F.col("within") + F.col("before")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    ranked = parts.join(F.broadcast(totals.sparkSession.createDataFrame(at, "part int, before long")), "part").withColumn("weight", weight).drop("part", "within", "before")
    share = 0.0
    while True:
        full = F.lit(share) * F.col("weight") > most * F.col("source_size")
        r = ranked.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (r["all"] - r["full"]) / r["open"] if r["open"] else share
        if now <= share:
            return ranked.select("source", "source_size", "rows", F.least(F.lit(share) * F.col("weight"), most * F.col("source_size")).alias("target"))
        share = now


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None) -> DataFrame:
    """row (all columns of `docs`), source, id, body (a digest of the text), mark (of all three), size and weight."""
    weight = quality(F.col(text_col)) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(1.0)), F.lit(1e-9))
    source, id_ = F.col(source_col).cast("string"), F.col(id_col).cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("row"), source.alias("source"), id_.alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), words(F.col(text_col)).alias("size"), weight.alias("weight"))
    return rows.withColumn("mark", F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")), F.coalesce("id", F.lit("")), "body")))


def _repeats(marked: DataFrame) -> DataFrame | None:
    """The marks that several rows share, as a stored table; None where all differ."""
    again = stored(marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark", F.lit(True).alias("again")), "mix-repeats")
    return again if again.head(1) else None


def _keyed(marked: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """The rows with their key, which tells rows that share id and text apart by a number from 0.

    The rows of a mark are numbered within the parts in which they are stored, and the numbers of
    the parts before are added, so a mark with any share of all rows is numbered in as many tasks.
    """
    rows = marked.withColumn("copy", F.lit(0).cast("long"))
    if repeats is not None:
        few = F.broadcast(repeats) if repeats.count() <= DRIVER_SOURCES else repeats
        found = rows.join(few, "mark", "left")
        some = stored(found.where("again").drop("again", "copy").withColumn("__at", F.monotonically_increasing_id()), "mix-copies").withColumn("__part", F.shiftright("__at", 33))
        parts = some.groupBy("mark", "__part").agg(F.count(F.lit(1)).alias("__n"))
        before = parts.withColumn("__before", F.sum("__n").over(Window.partitionBy("mark").orderBy("__part")) - F.col("__n")).drop("__n")
        place = F.row_number().over(Window.partitionBy("mark", "__part").orderBy("__at")) - 1
        numbered = some.withColumn("__place", place).join(before, ["mark", "__part"]).withColumn("copy", F.col("__before") + F.col("__place"))
        rows = found.where("again is null").drop("again").unionByName(numbered.select(*rows.columns))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce("id", F.lit("")), "body", F.col("copy").cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    return rows.withColumn("key", -F.log(u) / F.col("weight")).drop("weight", "copy", "mark", "body")


def _range(n: Column) -> Column:
    """The range a key falls in; it never falls as the key grows."""
    return F.least(F.floor((1.0 - F.exp(-F.col("key"))) * n), n - 1).cast("long")


def _per_source(rows: DataFrame, cut: DataFrame, small: bool) -> DataFrame:
    """Rows with their source's line beside them; there is one line for each source."""
    return rows.join(F.broadcast(cut) if small else cut, F.col("source").eqNullSafe(F.col("s")))


def cuts(keyed: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> tuple[DataFrame, bool]:
    """One row for each source: its size, target, whole epochs, ranges, and where the fractional part ends; and whether they are few."""
    totals = stored(keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), "mix-totals")
    small = totals.count() <= DRIVER_SOURCES
    if small:
        found = totals.collect()
        goal = targets({r["source"]: r["source_size"] for r in found}, weights, most)
        goals = totals.sparkSession.createDataFrame([(r["source"], r["source_size"], r["rows"], goal[r["source"]]) for r in found], "source string, source_size long, rows long, target double")
    else:
        goals = target_table(totals, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.when(F.col("epochs") < most, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(0.0))
    goals = goals.withColumn("ranges", F.greatest(F.lit(1), F.floor(F.sqrt("rows")).cast("long"))).withColumnRenamed("source", "s").drop("rows")
    goals = stored(goals, "mix-goals")

    ranged = _per_source(keyed, goals, small).withColumn("range", _range(F.col("ranges")))
    sums = ranged.groupBy("s", "range", "rest").agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.partitionBy("s").orderBy("range")) - F.col("size")
    ends = sums.withColumn("before", before).where("rest > 0 and before < rest and before + size >= rest")
    ends = stored(ends.select(F.col("s").alias("e"), F.col("range").alias("end_range"), "before"), "mix-ends")  # one row for each source
    few = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    rows = ranged.join(few(ends), F.col("s").eqNullSafe(F.col("e")) & (F.col("range") == F.col("end_range")))
    along = F.col("before") + F.sum("size").over(Window.partitionBy("e", "end_range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1))
    along = F.coalesce(along, F.col("before"))
    taken = rows.withColumn("along", along).where("along < rest and along + size / 2 <= rest")
    last = stored(taken.groupBy(F.col("e").alias("f")).agg(F.max(F.struct("key", "id")).alias("last")), "mix-last")
    out = goals.join(few(ends), F.col("s").eqNullSafe(F.col("e")), "left").join(few(last), F.col("s").eqNullSafe(F.col("f")), "left")
    out = stored(out.select("s", "source_size", F.round("target", 6).alias("target"), "epochs", "ranges", "end_range", "last"), "mix-cuts")
    discard(totals, goals, ends, last)
    return out, small


def _times() -> Column:
    """How often the mix takes a row."""
    at = _range(F.col("ranges"))
    early = (at < F.col("end_range")) | ((at == F.col("end_range")) & (F.struct("key", "id") <= F.col("last")))
    return F.col("epochs") + F.when(F.coalesce(early, F.lit(False)), 1).otherwise(0)


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, weight: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and times of every row.

    `weight` is a document's quality, a positive column of `docs` such as a score (null: 1); without
    one, `quality` of the text is taken. A null text has size 0, a null source is a source that
    comes last. Keys are of id, text and, among rows that share both, a number, so null and repeated
    ids are taken row by row; which of such rows is taken is open where they differ in other columns.
    Equal keys are ordered by id. Whole texts are counted in the JVM, however long, invalid UTF-8 as
    it is. An empty table gives no row, and other columns may have any names. The mix of a source
    ends at the row boundary nearest to its target.
    """
    marked = _marked(docs, id_col, text_col, source_col, weight)
    marked = stored(marked.select(F.col("row").getField(id_col).alias("doc_id"), *[c for c in marked.columns if c != "row"]), "mix-marks")
    repeats = _repeats(marked)
    rows = _keyed(marked, repeats)
    if repeats is not None:
        rows = stored(rows, "mix-sizes")
    found = _per_source(rows, *cuts(rows, weights, most))
    times = _times()
    return found.select("doc_id", "size", "source_size", "target", (times * F.col("size")).alias("taken"), times.alias("times"))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_EPOCHS, weight: Column | None = None) -> DataFrame:
    """The rows of `docs` as the mix takes them: a row taken twice comes twice; same columns. See `mixed`."""
    whole = _marked(docs, id_col, text_col, source_col, weight)
    marked = stored(whole.drop("row"), "mix-marks")
    repeats = _repeats(marked)
    sizes = stored(_keyed(marked, repeats), "mix-sizes")
    found = _per_source(_keyed(whole, repeats), *cuts(sizes, weights, most))
    discard(marked, sizes)
    return found.select("row", F.explode(F.array_repeat(F.lit(1), _times()))).select("row.*")


def _sql() -> str:
    weight = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  (('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, '')) || '|' || (row_number() OVER (PARTITION BY source, doc_id, coalesce(text, '')) - 1)), 1, 13))::BIGINT::DOUBLE + 0.5) / {2**52}::DOUBLE AS u,
  coalesce(1.0::DOUBLE - 0.5::DOUBLE * least(1.0::DOUBLE, 8.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE), 1.0::DOUBLE) AS q FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weight} END::DOUBLE AS w FROM t),
o AS (SELECT *, (sum(s) OVER () - {MOST_EPOCHS} * coalesce(sum(s) OVER (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
x AS (SELECT *, least({MOST_EPOCHS} * s, w * (SELECT share FROM o WHERE share * w <= {MOST_EPOCHS} * s ORDER BY s / w, source LIMIT 1)) AS target FROM o),
y AS (SELECT source, s, target, CASE WHEN s = 0 THEN 0 ELSE least({MOST_EPOCHS}, floor(target / s))::BIGINT END AS epochs FROM x),
k AS (SELECT doc_id, d.source, size, s, target, epochs, CASE WHEN epochs < {MOST_EPOCHS} THEN target - epochs * s ELSE 0 END AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / q, CAST(doc_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source)
SELECT doc_id, size, s AS source_size, round(target::DOUBLE, 6) AS target, CAST((epochs + CASE WHEN before < rest AND before + size / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM k"""


SQL = _sql()
