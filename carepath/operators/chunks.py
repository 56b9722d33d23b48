"""Passages with ids: running lines, reference pages, passages by page or section, and passages that survive edits.

Pages are rows (source, version, title, number, label, text). A page's lines stay one array, so what
is dropped at its edges needs no shuffle; only the forms of edge lines are counted across pages.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions.text import BROADCAST_ROWS, PASSAGE_WORDS, packed, paragraphs

#: Lines at either end of a page that may be running ones.
EDGE = 2
#: One line in so many closes a lasting passage, by a hash of its words.
SPREAD = 8


def lines(text: Column) -> Column:
    """The lines with text, without the blanks around them; a null text has none."""
    bare = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R|[\x1C-\x1E]"), lambda x: F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", ""))
    return F.filter(bare, lambda x: x != "")


def form(line: Column) -> Column:
    """A line with every number as '#', so that the printed page number does not tell lines apart."""
    return F.regexp_replace(line, r"\d+", "#")


def _at_edge(k: Column, n: Column) -> Column:
    return (k < EDGE) | (k >= n - EDGE)


def running_lines(pages: DataFrame, *, share: float = 0.5, fewest: int = 3, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, form, n and pages: the forms of edge lines on `share` of a source's pages or more, and `fewest` at least.

    A form counts once for a page, wherever at the edges it stands, so headers that change sides or
    move by a line are found. Counts are combined before the shuffle. A null source is a source; a
    page without text counts as a page.
    """
    own = pages.select(F.col(source_col).alias("source"), lines(F.col(text_col)).alias("lines"))
    edges = F.filter("lines", lambda x, k: _at_edge(k, F.size("lines")))
    forms = own.select("source", F.explode(F.array_distinct(F.transform(edges, form))).alias("form")).groupBy("source", "form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= fewest)
    totals = own.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("pages"))
    return forms.join(totals, F.col("source").eqNullSafe(F.col("of"))).where(F.col("n") >= share * F.col("pages")).drop("of")


def without_running(pages: DataFrame, *, found: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """`pages` with an array `lines` in place of text, rid of running lines in the first and last EDGE of each page.

    A line is running if its form is one of `found` (see `running_lines`) for its source, if one of
    the source's `starts` in `patterns` (source, starts, anywhere: arrays) matches where it begins, or one of
    `anywhere` within it. Lines away from the edges stay, whatever they say.
    """
    out = pages.withColumn("lines", lines(F.col("text"))).drop("text")
    none = F.array().cast("array<string>")
    extra = {"__forms": None if found is None else found.groupBy("source").agg(F.collect_set("form").alias("__forms")), "__patterns": None if patterns is None else patterns.select("source", F.concat(F.transform(F.coalesce("starts", none), lambda p: F.concat(F.lit("^(?:"), p, F.lit(")"))), F.coalesce("anywhere", none)).alias("__patterns"))}
    for name, df in extra.items():
        if df is None:
            out = out.withColumn(name, none)
            continue
        df = df.withColumnRenamed("source", "__of")  # a source has at most 2 * EDGE / share forms
        small = df.count() <= BROADCAST_ROWS
        out = out.join(F.broadcast(df) if small else df, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of").withColumn(name, F.coalesce(name, none))
    running = lambda x: F.array_contains("__forms", form(x)) | F.exists("__patterns", lambda p: F.rlike(x, p))
    kept = F.filter("lines", lambda x, k: ~(_at_edge(k, F.size("lines")) & running(x)))
    return out.withColumn("lines", kept).drop(*extra)


def reference_pages(pages: DataFrame, spec: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`pages` with in_references, and the sources of `spec` (source, first, last: printed labels) whose labels are not found.

    Of several pages with one label the last counts. A range that ends before it begins is empty;
    a source with a label not found has no reference pages and is named in the second table.
    """
    of = spec.select(F.col("source").alias("__of"), "first", "last")
    labelled = pages.where(F.col("label") != "").select("source", "label", "number").join(of, F.col("source").eqNullSafe(F.col("__of")))
    at = lambda c: F.max(F.when(F.col("label") == F.col(c), F.col("number")))
    found = labelled.groupBy("__of").agg(at("first").alias("__from"), at("last").alias("__to"))
    same = F.col("source").eqNullSafe(F.col("__of"))
    out = pages.join(found, same, "left").withColumn("in_references", F.coalesce(F.col("number").between(F.col("__from"), F.col("__to")), F.lit(False)))
    missing = spec.join(found.where("__from is not null and __to is not null"), same, "left_anti").where("first is not null or last is not null")
    return out.drop("__of", "__from", "__to"), missing


def _passages(units: Column, join: bool, most: int) -> Column:
    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda x: packed(paragraphs(list(x)) if join else list(x), most))

    run.__annotations__ = {"part": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<string>")(units)


def _named(rows: DataFrame, source: Column, version: Column, number: Column, where: Column, code: Column, passages: Column) -> DataFrame:
    cut = rows.select(source.alias("source"), version.alias("version"), "title", number.alias("number"), where.alias("where"), code.alias("code"), F.posexplode(passages).alias("n", "text"))
    id_ = F.concat("source", F.lit("@"), "version", F.lit("/"), "number", F.lit("."), (F.col("n") + 1).cast("string"))
    return cut.select(id_.alias("id"), "source", "version", "title", "where", "code", "text")


def document_chunks(pages: DataFrame, *, found: DataFrame | None = None, patterns: DataFrame | None = None, most: int = PASSAGE_WORDS) -> DataFrame:
    """id (<source>@<version>/<page>.<n>), source, version, title, where, code (null) and text of the passages of pages.

    No passage crosses a page. A page without a printed label is cited by its place in the file; a
    page without text gives no passage.
    """
    rows = without_running(pages, found=found, patterns=patterns)
    where = F.when(F.col("label") != "", F.concat(F.lit("p. "), "label")).otherwise(F.concat(F.lit("page "), F.col("number").cast("string"), F.lit(" of the file")))
    return _named(rows, F.col("source"), F.col("version"), F.col("number").cast("string"), where, F.lit(None).cast("string"), _passages(F.col("lines"), True, most))


def label_chunks(sections: DataFrame, *, most: int = PASSAGE_WORDS) -> DataFrame:
    """The same for the sections of drug labels (set_id, version, title, n, code, path, text): ids label:<set id>@v<version>/<section>.<n>.

    The lines of a section are its paragraphs, items and table rows; none is joined to the next one's text.
    """
    where = F.concat(F.lit("section "), F.array_join("path", " > "))
    return _named(sections, F.concat(F.lit("label:"), "set_id"), F.concat(F.lit("v"), F.col("version").cast("string")), F.col("n").cast("string"), where, F.col("code"), _passages(lines(F.col("text")), False, most))


def _lasting(text: str | None, most: int, spread: int) -> list[dict]:
    out: list[list[str]] = []
    n, open_ = 0, False
    for line in (text or "").split("\n"):
        ws = re.findall(r"[^\x20\x09-\x0D]+", line)
        for k in range(0, len(ws), most):
            piece = " ".join(ws[k : k + most])
            if not open_:
                out.append([])
                n = 0
            elif n // most != block:
                out.append([])
            block, open_ = n // most, True
            n += len(ws[k : k + most])
            out[-1].append(piece)
            if int(hashlib.md5(piece.encode()).hexdigest()[:8], 16) % spread == 0:
                open_ = False
    seen: Counter[str] = Counter()
    rows = []
    for n, x in enumerate((" ".join(x) for x in out), 1):
        key = hashlib.sha256(x.encode()).hexdigest()[:16]
        seen[key] += 1
        rows.append({"key": f"{key}.{seen[key]}", "n": n, "text": x})
    return rows


def lasting_chunks(docs: DataFrame, id_col: str, text_col: str, *, most: int = PASSAGE_WORDS, spread: int = SPREAD) -> DataFrame:
    """(id, key, n, text): passages whose bounds and keys follow from their own words, so an edit changes only those it touches.

    A line whose hash is divisible by `spread` closes a passage; between two such lines a passage is
    also cut where another `most` words are full, and lines of more than `most` words are cut before, so none has
    2 * `most` words. What comes after the first closing line behind an edit keeps its key, wherever
    it has moved. The key is 64 bits of the passage's digest and which of its equals in the document it is. A text
    without words has no passage. Whole texts are read in one pass without a shuffle.
    """

    def run(part: pd.Series) -> pd.Series:
        return part.map(lambda t: _lasting(t, most, spread))

    run.__annotations__ = {"part": pd.Series, "return": pd.Series}
    cut = F.pandas_udf(run, "array<struct<key string, n int, text string>>")(F.make_valid_utf8(F.col(text_col)))
    return docs.select(F.col(id_col).alias("__id"), F.explode(cut).alias("x")).select(F.col("__id").alias(id_col), "x.key", "x.n", "x.text")
