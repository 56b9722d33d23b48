"""Line deduplication by site-relative frequency.

Within a host, a line that more than RATIO of its pages hold, and two of them at least, is
boilerplate of the site and is dropped from all of them. With `merge_copies` the copies of a whole
page are one page, so that a text posted many times is not taken for boilerplate. Pages are told
apart by 128 bits of hash of their text and lines by 128 bits of their own; both counts are combined
before the shuffle, so a hot host, page or line is spread. What goes back to the pages is each host's set of boilerplate lines: at most its
mean number of distinct lines a page divided by RATIO. The sets are broadcast only when they are few
and else joined on (host, salt), so that a host's pages are dealt to as many tasks as its size asks
for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.llm.common import BLANKS, discard, stored

#: Share of a host's pages that a line may be on, and fewest pages that must hold it: a line of one page repeats nowhere.
RATIO, FEWEST_HITS = 0.05, 2
#: Boilerplate lines up to which their sets are broadcast (16 bytes each), and the pages of a host for each salt of the join beyond it.
BROADCAST_LINES, SALT_PAGES = 200_000, 100_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128 bits that stand for a line without the blanks around it; null for a blank line."""
    bare = F.trim(line, F.lit(BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit("second")).alias("b")))


def _page_keys(text: Column) -> Column:
    """The keys of a page's distinct lines."""
    return F.array_distinct(F.array_compact(F.transform(_lines(text), _key)))


def boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", ratio: float = RATIO, fewest_hits: int = FEWEST_HITS, merge_copies: bool = False) -> DataFrame:
    """host, pages (their number) and lines: the keys of the lines of each host that more than `ratio` of its pages hold; a stored table."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pages = docs.select(F.col(host_col).alias("host"), text.alias("text"))
    if merge_copies:
        page = F.struct(F.xxhash64("text").alias("c"), F.xxhash64("text", F.lit("second")).alias("d"))
        pages = pages.select("host", page.alias("page"), _page_keys(F.col("text")).alias("keys"))
        pages = stored(pages.dropDuplicates(["host", "page"]).select("host", "keys"), "pages")
    else:
        pages = pages.select("host", _page_keys(F.col("text")).alias("keys"))
    held = pages.select("host", F.explode("keys").alias("key")).select("host", "key.a", "key.b")
    counts = held.groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest_hits)
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("pages"))
    often = counts.join(totals, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("pages"))
    found = stored(often.groupBy("host", "pages").agg(F.collect_list(F.struct("a", "b")).alias("lines")), "boilerplate")
    discard(pages)
    return found


def cleaned(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", **rule: float) -> DataFrame:
    """row (the columns of `docs`, the text rid of boilerplate lines), n_lines and n_dropped of every row.

    A null text stays null and has no lines; blank lines stay. A null host is a host, and hosts of
    all sizes are judged alike. Rows that repeat a text are as many pages when lines are counted
    (with `merge_copies` one), and are all cleaned. Whole texts are read, however long. There are no ties: a share of exactly
    the ratio stays. An empty table gives no row; a row is kept as one column on the way, so
    other columns may have any names.
    """
    found = boilerplate(docs, text_col=text_col, host_col=host_col, **rule)
    size, pages = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)), F.coalesce(F.max("pages"), F.lit(0))).first()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(host_col).alias("own_host"))
    same = F.col("own_host").eqNullSafe(F.col("host"))
    if size <= BROADCAST_LINES:
        both = rows.join(F.broadcast(found), same, "left")
    else:
        salts = 1 + pages // SALT_PAGES
        to = found.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        both = rows.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(salts)).cast("int")).join(to, same & (F.col("salt") == F.col("to")), "left")
    lines = _lines(F.col("text"))
    both = both.withColumn("hit", F.when(F.col("lines").isNotNull() & F.col("text").isNotNull(), F.array_intersect(_page_keys(F.col("text")), F.col("lines"))))
    touched = F.size("hit") > 0
    out = both.withColumn("stay", F.when(touched, F.filter(lines, lambda x: F.coalesce(~F.array_contains(F.col("hit"), _key(x)), F.lit(True)))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col("stay").isNull(), 0).otherwise(F.size(lines) - F.size("stay")).cast("long")
    kept = F.when(F.col("stay").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n"))
    row = F.struct(*[kept.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return out.select(row.alias("row"), n.alias("n_lines"), dropped.alias("n_dropped"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **rule: float) -> DataFrame:
    """doc_id, source, n_lines, n_dropped and the cleaned text of every row; see `cleaned`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("source"), F.col(text_col).alias("text"))
    return cleaned(rows, **rule).select("row.doc_id", "row.source", "n_lines", "n_dropped", "row.text")


SQL = rf"""
WITH l AS (SELECT doc_id, source, text, k, line, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, source, text, k, ls[k] AS line FROM (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents))),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT l.source, bare FROM l JOIN p ON l.source IS NOT DISTINCT FROM p.source WHERE bare <> ''
  GROUP BY l.source, bare, pages HAVING count(DISTINCT doc_id) >= {FEWEST_HITS} AND count(DISTINCT doc_id) > {RATIO} * pages),
g AS (SELECT doc_id, k, line, b.bare IS NOT NULL AS gone FROM l LEFT JOIN b ON l.source IS NOT DISTINCT FROM b.source AND l.bare = b.bare)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(stay, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS stay FROM g GROUP BY doc_id) s ON d.doc_id = s.doc_id"""
