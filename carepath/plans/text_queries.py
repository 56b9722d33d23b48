"""Queries for running lines, reference pages, lasting passages and the census of statements, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions.text import PASSAGE_WORDS
from carepath.operators import census, chunks
from carepath.plans.table_queries import _t, query

_EDGES = """
WITH p AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT DISTINCT source, doc_id, regexp_replace(ls[k], '[0-9]+', '#', 'g') AS form FROM (SELECT source, doc_id, ls, unnest(list_distinct([1, 2, len(ls) - 1, len(ls)])) AS k FROM p) WHERE k BETWEEN 1 AND len(ls)),
f AS (SELECT e.source, form, count(*) AS n, any_value(t.pages) AS pages FROM e JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY 1) t ON e.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) >= 0.02 * any_value(t.pages))
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources as documents and their rows as pages."""
    return _t(spark, sf_dir, "documents").select("source", F.lit("1").alias("version"), F.col("source").alias("title"), F.col("doc_id").alias("number"), F.lit(None).cast("string").alias("label"), "text")


@query(_EDGES + "SELECT source, form, n, pages FROM f")
def running_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand first or last on one in fifty of a source's documents or more, numbers apart."""
    return chunks.running_lines(_pages(spark, sf_dir), share=0.02)


@query(_EDGES + """, c AS (SELECT p.source, p.doc_id, ls, unnest(list_distinct([1, 2, len(ls) - 1, len(ls)])) AS k FROM p),
r AS (SELECT c.doc_id, count(*) AS dropped FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source AND regexp_replace(ls[k], '[0-9]+', '#', 'g') = f.form WHERE k BETWEEN 1 AND len(ls) GROUP BY 1)
SELECT p.doc_id, len(ls)::BIGINT - coalesce(dropped, 0) AS n_lines FROM p LEFT JOIN r USING (doc_id)""")
def lines_without_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document keeps once the running ones of its source are gone from its edges."""
    pages = _pages(spark, sf_dir)
    out = chunks.without_running(pages, found=chunks.running_lines(pages, share=0.02))
    return out.select(F.col("number").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"))


@query("""
WITH p AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 > 0 THEN 'S' || turn % 4 END AS label FROM conversations),
s AS (SELECT DISTINCT conv_id, 'S' || conv_id % 4 AS first, 'S' || (conv_id + 1) % 4 AS last FROM conversations WHERE conv_id % 3 < 2),
b AS (SELECT conv_id, max(turn) FILTER (label = first) AS a, max(turn) FILTER (label = last) AS z FROM p JOIN s USING (conv_id) GROUP BY 1)
SELECT conv_id, turn, coalesce(turn BETWEEN a AND z, false) AS in_references, conv_id % 3 < 2 AND (a IS NULL OR z IS NULL) AS missing FROM p LEFT JOIN b USING (conv_id)""")
def references_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, some with printed labels, and which of them lie between the first and last label of their conversation's references."""
    c = _t(spark, sf_dir, "conversations")
    label = F.when(F.length("text") % 5 > 0, F.concat(F.lit("S"), (F.col("turn") % 4).cast("string")))
    of = lambda k: F.concat(F.lit("S"), ((F.col("source") + k) % 4).cast("string"))
    spec = c.select(F.col("conv_id").alias("source")).distinct().where("source % 3 < 2").select("source", of(0).alias("first"), of(1).alias("last"))
    marked, missing = chunks.reference_pages(c.select(F.col("conv_id").alias("source"), F.col("turn").alias("number"), label.alias("label")), spec)
    out = marked.join(missing.select("source", F.lit(True).alias("missing")), "source", "left")
    return out.select(F.col("source").alias("conv_id"), F.col("number").alias("turn"), "in_references", F.coalesce("missing", F.lit(False)).alias("missing"))


@query(rf"""
WITH l AS (SELECT doc_id, k, regexp_extract_all(ls[k], '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
p AS (SELECT doc_id, k, j, ws[j * {PASSAGE_WORDS} + 1 : (j + 1) * {PASSAGE_WORDS}] AS ws FROM (SELECT *, unnest(range(0, (len(ws) + {PASSAGE_WORDS - 1}) // {PASSAGE_WORDS})) AS j FROM l)),
c AS (SELECT doc_id, k, j, array_to_string(ws, ' ') AS piece, len(ws) AS n, (('0x' || substr(md5(array_to_string(ws, ' ')), 1, 8))::BIGINT % {chunks.SPREAD} = 0)::INT AS closes FROM p),
r AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id, run ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {PASSAGE_WORDS} AS block FROM r),
x AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY k, j) AS text, min(k * 1000000 + j) AS place FROM b GROUP BY doc_id, run, block),
y AS (SELECT doc_id, place, text, substr(sha256(text), 1, 16) AS key FROM x)
SELECT doc_id, key || '.' || row_number() OVER (PARTITION BY doc_id, key ORDER BY place) AS key, row_number() OVER (PARTITION BY doc_id ORDER BY place)::INT AS n, text FROM y""")
def lasting_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in passages whose keys outlive edits elsewhere in it."""
    return chunks.lasting_chunks(_t(spark, sf_dir, "documents"), "doc_id", "text")


#: What the labels of the parts say, by a line's order, and the kinds of those sentences.
SAID = (
    ("Do not start if eGFR is below @.", ("eGFR threshold",)),
    ("Adjust the dose for creatinine clearance less than @ mL/min.", ("creatinine-clearance threshold",)),
    ("Monitor renal function every @ months.", ("lab monitoring with a time word",)),
    ("eGFR falls with age.", ()),
    ("Assess serum creatinine.", ()),
    ("Check hemoglobin at least yearly; eGFR ≥ @ is needed.", ("eGFR threshold",)),
    ("Measure hemoglobin weekly; CrCl > @ is needed.", ("lab monitoring with a time word", "creatinine-clearance threshold")),
)
_KINDS = ", ".join(f"({k}, '{kind}')" for k, (_, kinds) in enumerate(SAID) for kind in kinds)


@query(f"""
WITH k(said, kind) AS (VALUES {_KINDS}),
s AS (SELECT l_partkey, unnest([l_orderkey % 7, (l_orderkey + 3) % 7]) AS said FROM lineitem WHERE l_linenumber <> 2)
SELECT kind, count(*) AS sentences, count(DISTINCT l_partkey) AS labels FROM s JOIN k USING (said) GROUP BY kind""")
def label_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by kind in two sentences for each line, with its quantity in them; second lines are sections that are not read."""
    said = F.array(*[F.lit(x) for x, _ in SAID])
    one = lambda k: F.replace(F.element_at(said, ((F.col("l_orderkey") + k) % 7 + 1).cast("int")), F.lit("@"), F.col("l_quantity").cast("int").cast("string"))
    code = F.when(F.col("l_linenumber") == 2, census.SKIPPED[3]).when(F.col("l_linenumber") > 2, "34068-7")
    sections = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("label"), code.alias("code"), F.concat(one(0), F.lit("\n"), one(3)).alias("text"))
    return census.census(sections)
