"""Queries for sentence checks, changed stores, resampled intervals and the knowledge graph on the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.functions import text as tx
from carepath.operators import core, digests, evaluation, knowledge, sentences
from carepath.plans.table_queries import _t, query
from carepath.sources.scratch import scratch_path


@query("""
WITH o AS (SELECT o_orderkey AS pack, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR) AS price, CAST(CAST(o_totalprice AS DECIMAL(15, 2)) + 1 AS VARCHAR) AS more, CAST(o_orderkey % 12 AS INTEGER) AS sentence FROM orders)
SELECT pack, sentence, CASE sentence WHEN 0 THEN 'The total was ' || price || ' on ' || strftime(d, '%Y-%m-%d') || '.' WHEN 1 THEN 'The total was ' || more || '.' WHEN 2 THEN 'Il totale era ' || replace(price, '.', ',') || ' del ' || strftime(d, '%d/%m/%Y') || '.'
  WHEN 3 THEN 'It was ordered on ' || strftime(d + 1, '%Y-%m-%d') || '.' WHEN 4 THEN 'You have anaemia.' WHEN 5 THEN 'The total of this order is ' || price || '.' WHEN 6 THEN 'Please stop it.' WHEN 7 THEN 'It was low.' WHEN 8 THEN 'It was low.'
  WHEN 9 THEN 'Ordered in ' || monthname(d) || ' ' || year(d) || '.' WHEN 10 THEN 'As shown in F it was ' || price || '.' ELSE 'KDIGO puts it in stage 3.' END AS text,
  CASE sentence WHEN 1 THEN 'number not in cited items' WHEN 3 THEN 'date not in cited items' WHEN 4 THEN 'diagnostic wording' WHEN 5 THEN 'wrong language' WHEN 6 THEN 'treatment instruction' WHEN 7 THEN 'unknown citation E9' WHEN 8 THEN 'no citation'
  WHEN 10 THEN 'item ID in the text' WHEN 11 THEN 'number not in cited items; category not from the rule; source not in cited items' ELSE '' END AS problems FROM o""")
def sentence_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence about every order, right or wrong in a way that its key decides, against the order's own facts."""
    d, price = F.to_date("o_orderdate"), F.col("o_totalprice").cast("decimal(15,2)")
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack"), d.alias("d"), price.cast("string").alias("price"), (price + F.lit(1)).cast("decimal(15,2)").cast("string").alias("more"), (F.col("o_orderkey") % 12).cast("int").alias("sentence"))
    iso, s = F.date_format("d", "yyyy-MM-dd"), F.lit
    said = [
        (s("The total was "), F.col("price"), s(" on "), iso, s("."), s(" [E1, F]")), (s("The total was "), F.col("more"), s(".")), (s("Il totale era "), F.translate("price", ".", ","), s(" del "), F.date_format("d", "dd/MM/yyyy"), s(".")),
        (s("It was ordered on "), F.date_format(F.date_add("d", 1), "yyyy-MM-dd"), s(".")), (s("You have anaemia."),), (s("The total of this order is "), F.col("price"), s(".")), (s("Please stop it."),), (s("It was low."),), (s("It was low."),),
        (s("Ordered in "), F.date_format("d", "MMMM yyyy"), s(", as noted in E1.")), (s("As shown in F it was "), F.col("price"), s(".")), (s("KDIGO puts it in stage 3."),),
    ]
    text = F.element_at(F.array(*[F.concat(*x) for x in said]), F.col("sentence") + 1)
    cites = F.when(F.col("sentence") == 7, F.array(s("E1"), s("E9"))).when(F.col("sentence") == 8, F.array().cast("array<string>")).otherwise(F.array(s("E1")))
    asked = o.select("pack", "sentence", text.alias("text"), cites.alias("cites"), F.when(F.col("sentence").isin(2, 5), "it").otherwise("en").alias("language"))
    fact = o.select("pack", s("E1").alias("item"), s("evidence").alias("kind"), F.concat(iso, s(": Total: "), "price", s(" USD")).alias("text"), F.col("d").alias("day"))
    flag = o.select("pack", s("F").alias("item"), s("flag").alias("kind"), s("Total of one order").alias("text"), s(None).cast("date").alias("day"))
    return sentences.checked(asked, fact.unionByName(flag)).select("pack", "sentence", "text", F.array_join("problems", "; ").alias("problems"))


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders),
a AS (SELECT o_custkey, list((o_orderkey, o_orderstatus, o_totalprice) ORDER BY o_orderkey) AS rows FROM o WHERE o_orderdate < DATE '1997-06-01' GROUP BY 1),
b AS (SELECT o_custkey, list((o_orderkey, o_orderstatus, o_totalprice) ORDER BY o_orderkey) AS rows FROM o WHERE o_orderdate >= DATE '1993-01-01' GROUP BY 1)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS what FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.rows IS DISTINCT FROM b.rows""")
def changed_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in which a store of the orders before a day and one of those since another day differ, by trees of digests."""
    o = _t(spark, sf_dir, "orders")
    paths = []
    for kept in ("o_orderdate < date'1997-06-01'", "o_orderdate >= date'1993-01-01'"):
        paths.append(scratch_path(spark, "store-digests"))
        found = digests.patient_digests(o.where(kept), "o_custkey", ["o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])
        digests.save_tree(found, paths[-1], "o_custkey", parts=8, branches=8)
    return digests.changed(spark, *paths, "o_custkey")


@query(f"""
WITH a AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS k, l_quantity FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_quantity) AS k, l_quantity FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT a.l_partkey % 10 AS family, a.l_partkey AS c, count(*) FILTER (a.l_quantity <= b.l_quantity) AS k, count(*) AS n FROM a JOIN b ON a.l_partkey = b.l_partkey AND a.k = b.k GROUP BY 1, 2),
w AS (SELECT family, r, k, n, (SELECT count(*) FROM (SELECT unnest({list(evaluation.POISSON)}) AS p) WHERE ('0x' || substr(md5('bootstrap|' || c || '|' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= p) AS w FROM c, range(200) AS t(r)),
v AS (SELECT family, list_sort(list(k / n)) AS v FROM (SELECT family, r, sum(w * k)::DOUBLE AS k, sum(w * n) AS n FROM w GROUP BY 1, 2 HAVING sum(w * n) > 0) GROUP BY 1)
SELECT family, sum(n)::BIGINT AS n, round(sum(k) / sum(n), 9) AS estimate, round(any_value(v[1 + floor(0.025 * (len(v) - 1))::BIGINT]), 9) AS low, round(any_value(v[1 + floor(0.975 * (len(v) - 1))::BIGINT]), 9) AS high, false AS exact FROM c JOIN v USING (family) GROUP BY family""")
def share_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By family of parts, the share of paired lines whose open quantity is not above the filled one, with parts resampled whole."""
    lines, order = _t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"]
    pairs = core.kth_pairs(lines.where("l_linestatus = 'O'"), lines.where("l_linestatus = 'F'"), ["l_partkey"], order, order, "l_quantity", "l_quantity")
    rows = pairs.where("left_value is not null and right_value is not null").withColumn("family", F.col("l_partkey") % 10)
    out = evaluation.bootstrap(rows, ["family"], "l_partkey", F.when(F.col("left_value") <= F.col("right_value"), 1).otherwise(0), F.lit(1), replicates=200)
    return out.select("family", "n", *[F.round(c, 9).alias(c) for c in ("estimate", "low", "high")], "exact")


_KNOWLEDGE = r"""
WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\pL\pN]+') AS ws FROM conversations),
t AS (SELECT conv_id, max(turn) AS last, string_agg(' ' || array_to_string(ws, ' ') || ' ', '' ORDER BY turn) AS words FROM w GROUP BY 1),
s AS (SELECT 'conversation:' || (conv_id + turn % 3) AS document, 'statement:' || conv_id || '.' || turn AS node, conv_id + turn % 3 AS of, array_to_string(ws, ' ') AS quote FROM w WHERE len(ws) > 0),
f AS (SELECT s.node, s.document, t.conv_id IS NOT NULL AS known, coalesce(contains(replace(words, '  ', ' '), ' ' || quote || ' '), false) AS held FROM s LEFT JOIN t ON t.conv_id = s.of)
"""


@query(_KNOWLEDGE + """SELECT 'conversation:' || conv_id AS node, 'document' AS kind, NULL AS problem FROM t
UNION ALL SELECT node, 'statement', CASE WHEN NOT known THEN 'unknown' WHEN NOT held THEN 'not in the document' END FROM f""")
def knowledge_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents and their turns as statements, some of which quote another conversation, with what is wrong with them."""
    graph, wrong = _knowledge(spark, sf_dir)
    what = F.when(F.contains("problem", F.lit("not a stored")), "unknown").otherwise("not in the document")
    bad = wrong.select("node", what.alias("problem")).distinct()
    return graph.nodes.select("node", "kind", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("node", F.lit("statement").alias("kind"), "problem"))


def _knowledge(spark: SparkSession, sf_dir: str) -> tuple[knowledge.Knowledge, DataFrame]:
    c, none = _t(spark, sf_dir, "conversations"), F.lit(None).cast("string")
    name = lambda id_: F.concat(F.lit("conversation:"), id_.cast("string"))
    documents = c.select(name(F.col("conv_id")).alias("node")).distinct().select("node", F.lit("document").alias("kind"), F.col("node").alias("title"), none.alias("citation"))
    pages = c.select(name(F.col("conv_id")).alias("document"), F.col("turn").alias("number"), F.col("turn").cast("string").alias("label"), "text")
    passages = pages.select("document", "number", F.concat_ws("/", "document", "label").alias("id"), F.concat(F.lit("p. "), "label").alias("place"), "text")
    said = F.array_join(tx.words(F.col("text")), " ")
    asked = c.select(F.concat(F.lit("statement:"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("node"), name(F.col("conv_id") + F.col("turn") % 3).alias("document"), none.alias("citation"), none.alias("locator"), said.alias("quote"), none.alias("table")).where("quote <> ''")
    drugs = spark.createDataFrame([], "rxcui string, label string, detail string, reason string")
    guidance = spark.createDataFrame([], "code string, document string, detail string")
    return knowledge.build(documents, pages, passages, asked, drugs, guidance, cut=tx.words)
