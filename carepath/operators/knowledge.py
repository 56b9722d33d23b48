"""The knowledge graph: documents, labels and checked statements, and the links between them and concepts.

Nodes are addressed by what they hold. A document or label has the digest of its own columns and
pages, a statement that of its own columns and of the document it quotes, so a change reaches what
rests on it and nothing else. Building again makes only the nodes whose digests are new, and checks
only their quotes; the others are taken from the graph as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carepath.functions.text import tokens
from carepath.operators import quotes
from carepath.operators.digests import row_digest
from carepath.sources.scratch import stored

KINDS = ("document", "label", "statement")


class Knowledge(NamedTuple):
    """nodes (node, kind, title, citation, locator, quote, passages, digest), links (concept, to, kind, detail), and the drugs without a label (concept, reason)."""

    nodes: DataFrame
    links: DataFrame
    unlabelled: DataFrame


class KnowledgeError(RuntimeError):
    """What is wrong with the inputs of a graph."""


def sources(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """node, kind, title, citation and digest of every document and label.

    `documents` has node, kind (document or label), title and citation, `pages` document (a node),
    number, label and text. The digest is over the columns and over the digests of the pages in order.
    """
    page = F.struct("number", row_digest(["number", "label", "text"]).alias("d"))
    held = pages.select(F.col("document").alias("node"), page.alias("p")).groupBy("node").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["d"]), ""), 256).alias("__pages"))
    rows = documents.select("node", "kind", "title", "citation").join(held, "node", "left")
    return rows.withColumn("digest", row_digest(["node", "kind", "title", "citation", "__pages"])).drop("__pages")


def wanted(statements: DataFrame, found: DataFrame) -> DataFrame:
    """Statements with the digest of their columns and of the source that they quote, which is null where the source is unknown."""
    to = found.select(F.col("node").alias("document"), F.col("digest").alias("__of"))
    return statements.join(to, "document", "left").withColumn("digest", row_digest(["node", "document", "citation", "locator", "quote", "table", "__of"])).withColumn("known", F.col("__of").isNotNull()).drop("__of")


def checked(asked: DataFrame, pages: DataFrame, passages: DataFrame, *, cut: Callable[[Column], Column] = tokens) -> tuple[DataFrame, DataFrame]:
    """The statement nodes among `asked` whose quotes hold, and node and problem of the others."""
    quote = asked.where("known").withColumnRenamed("node", "quote_id")
    wrong = stored(quotes.problems(quote, pages, cut=cut).select(F.col("quote_id").alias("node"), F.concat("problem", F.lit(": "), "text").alias("problem")), "quotes-wrong")
    unknown = asked.where(~F.col("known")).select("node", F.concat("document", F.lit(" is not a stored document or a locked label")).alias("problem"))
    held = quotes.passage_ids(quote, passages, cut=cut).select(F.col("quote_id").alias("node"), F.col("ids").alias("passages")).where(F.size("passages") > 0)
    held = stored(held, "quotes-held")  # what was found is read by the nodes and by the problems
    sound = asked.where("known").join(wrong.select("node").distinct(), "node", "left_anti")
    lost = sound.join(held, "node", "left_anti").select("node", F.lit("the quote is in the text but in no single passage run").alias("problem"))
    nodes = sound.join(held, "node").select("node", F.lit("statement").alias("kind"), F.col("locator").alias("title"), "citation", "locator", "quote", "passages", "digest")
    return nodes, wrong.unionByName(unknown).unionByName(lost)


def build(documents: DataFrame, pages: DataFrame, passages: DataFrame, statements: DataFrame, drugs: DataFrame, guidance: DataFrame, *, before: DataFrame | None = None, cut: Callable[[Column], Column] = tokens) -> tuple[Knowledge, DataFrame]:
    """The graph, and node and problem of every statement that does not hold.

    `statements` has node, document, citation, locator, quote and table; `drugs` rxcui, label (a node or
    null), detail and reason; `guidance` code, document and detail; `passages` document, number, id,
    place and text. `before` are the nodes of an earlier graph: what has its digest is not made again.
    """
    found = sources(documents, pages)
    asked = stored(wanted(statements, found), "statements-asked")
    same = before.select("node", "digest").distinct() if before is not None else asked.select("node", "digest").limit(0)
    fresh = asked.join(same, ["node", "digest"], "left_anti")
    made, problems = checked(fresh, pages.join(fresh.select("document").distinct(), "document", "left_semi"), passages.join(fresh.select("document").distinct(), "document", "left_semi"), cut=cut)
    none = F.lit(None).cast("string")
    nodes = found.select("node", "kind", "title", "citation", none.alias("locator"), none.alias("quote"), F.array().cast("array<string>").alias("passages"), "digest").unionByName(made)
    if before is not None:
        nodes = nodes.unionByName(before.where("kind = 'statement'").join(asked.select("node", "digest"), ["node", "digest"], "left_semi").select(*nodes.columns))
    labelled = drugs.where("label is not null").select(F.concat(F.lit("medication_request|"), "rxcui").alias("concept"), F.col("label").alias("to"), F.lit("labelled_by").alias("kind"), "detail")
    guided = guidance.select(F.concat(F.lit("condition|"), "code").alias("concept"), F.col("document").alias("to"), F.lit("guided_by").alias("kind"), "detail").distinct()
    quoted = nodes.where("kind = 'statement'").join(asked.select("node", "document"), "node").select(F.col("node").alias("concept"), F.col("document").alias("to"), F.lit("quotes").alias("kind"), F.col("locator").alias("detail"))
    unlabelled = drugs.where("label is null").select(F.concat(F.lit("medication_request|"), "rxcui").alias("concept"), F.coalesce("reason", F.lit("the lock gives no label")).alias("reason"))
    return Knowledge(nodes, labelled.unionByName(guided).unionByName(quoted), unlabelled), problems


def changes(before: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and what (added, changed or removed) of the nodes in which two graphs differ."""
    a, b = before.select("node", F.col("digest").alias("a")), nodes.select("node", F.col("digest").alias("b"))
    both = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("node", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("what"))


def checked_or_raise(problems: DataFrame, *, shown: int = 100) -> None:
    """Raises with the first problems, if there are any."""
    rows = problems.orderBy("node", "problem").limit(shown + 1).collect()
    if rows:
        raise KnowledgeError("\n".join(f"{r['node']}: {r['problem']}" for r in rows[:shown]) + ("\n..." if len(rows) > shown else ""))


def shown(graph: Knowledge, concepts: DataFrame, cited: DataFrame) -> DataFrame:
    """node, and whether it is cited: the sources joined to `concepts` (concept) or quoted by the `cited` statements (node), and every statement that quotes any of them."""
    quoting = graph.links.where("kind = 'quotes'")
    joined = graph.links.where("kind <> 'quotes'").join(concepts.select("concept").distinct(), "concept", "left_semi").select("to")
    named = quoting.join(cited.select(F.col("node").alias("concept")).distinct(), "concept", "left_semi").select("to")
    to = joined.unionByName(named).distinct()
    statements = quoting.join(to, "to", "left_semi").select(F.col("concept").alias("node"))
    marks = cited.select("node").distinct().withColumn("cited", F.lit(True))
    rows = graph.nodes.select("node").join(to.withColumnRenamed("to", "node").unionByName(statements).distinct(), "node", "left_semi")
    return rows.join(marks, "node", "left").select("node", F.coalesce("cited", F.lit(False)).alias("cited"))
