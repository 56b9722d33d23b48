"""The knowledge graph: what it holds, what is wrong with its inputs, and what a change makes again."""

import pytest

from carepath.operators import knowledge as kn

PAGE = "document string, number int, label string, text string"


def inputs(spark, *, dose="Start with 10 mg once daily. Do not use below 30.", quote="Do not use below 30", title="Guide", more=()):
    documents = spark.createDataFrame([("document:guide", "document", title, "Guide 2024"), ("label:s1@v2", "label", "Drug", "Drug label")], "node string, kind string, title string, citation string")
    rows = [("document:guide", 1, "1", "Test kidney function once a year."), ("document:guide", 2, "2", "Repeat at three months."), ("label:s1@v2", 1, "Dose", dose)]
    pages = spark.createDataFrame(rows, PAGE)
    passages = spark.createDataFrame([(d, n, f"{d}/{n}", f"section {x}" if d.startswith("label") else f"p. {x}", t) for d, n, x, t in rows], "document string, number int, id string, place string, text string")
    said = [("statement:year", "document:guide", "Guide", "p. 1", "kidney function once a year", None), ("statement:low", "label:s1@v2", "Label", "section Dose", quote, None), *more]
    statements = spark.createDataFrame(said, "node string, document string, citation string, locator string, quote string, table string")
    drugs = spark.createDataFrame([("1", "label:s1@v2", "tier 1", None), ("2", None, None, None), ("3", None, None, "no listing")], "rxcui string, label string, detail string, reason string")
    guidance = spark.createDataFrame([("431", "document:guide", "CKD"), ("431", "document:guide", "CKD")], "code string, document string, detail string")
    return documents, pages, passages, statements, drugs, guidance


def test_nodes_links_and_drugs_without_a_label(spark):
    graph, problems = kn.build(*inputs(spark))
    kn.checked_or_raise(problems)
    nodes = {r.node: r for r in graph.nodes.collect()}
    assert set(nodes) == {"document:guide", "label:s1@v2", "statement:year", "statement:low"}
    assert nodes["statement:year"].passages == ["document:guide/1"] and nodes["statement:low"].passages == ["label:s1@v2/1"]
    assert {(r.concept, r.to, r.kind) for r in graph.links.collect()} == {
        ("medication_request|1", "label:s1@v2", "labelled_by"), ("condition|431", "document:guide", "guided_by"),
        ("statement:year", "document:guide", "quotes"), ("statement:low", "label:s1@v2", "quotes"),
    }
    assert graph.links.count() == 4
    assert {(r.concept, r.reason) for r in graph.unlabelled.collect()} == {("medication_request|2", "the lock gives no label"), ("medication_request|3", "no listing")}
    shown = kn.shown(graph, spark.createDataFrame([("condition|431",)], "concept string"), spark.createDataFrame([("statement:low",)], "node string"))
    assert {(r.node, r.cited) for r in shown.collect()} == {("document:guide", False), ("statement:year", False), ("label:s1@v2", False), ("statement:low", True)}


def test_every_problem_is_told(spark):
    more = [("statement:lost", "document:old", "Old", "p. 1", "anything", None), ("statement:page", "document:guide", "Guide", "p. 2", "kidney function once a year", None)]
    graph, problems = kn.build(*inputs(spark, quote="Never use", more=more))
    with pytest.raises(kn.KnowledgeError) as told:
        kn.checked_or_raise(problems)
    assert [line.split(":")[1].strip() for line in str(told.value).split("\n")] == ["lost", "low", "page"]
    assert "document:old is not a stored document" in str(told.value) and "not where the locator says" in str(told.value)
    assert {r.node for r in graph.nodes.where("kind = 'statement'").collect()} == {"statement:year"}


def test_only_what_changed_is_made_again(spark, monkeypatch):
    first, _ = kn.build(*inputs(spark))
    before = first.nodes.cache()
    asked, real = [], kn.checked
    monkeypatch.setattr(kn, "checked", lambda rows, *more, **kw: asked.append(rows) or real(rows, *more, **kw))
    again, problems = kn.build(*inputs(spark), before=before)
    assert asked[-1].count() == 0 and problems.count() == 0 and kn.changes(before, again.nodes).count() == 0
    assert {r.node: r.passages for r in again.nodes.collect()} == {r.node: r.passages for r in before.collect()}
    new, _ = kn.build(*inputs(spark, dose="Start with 5 mg. Do not use below 30."), before=before)
    assert [r.node for r in asked[-1].collect()] == ["statement:low"]  # what rests on the changed label
    assert {(r.node, r.what) for r in kn.changes(before, new.nodes).collect()} == {("label:s1@v2", "changed"), ("statement:low", "changed")}
    assert {r.node for r in new.nodes.collect()} == {r.node for r in before.collect()}
    broken, problems = kn.build(*inputs(spark, dose="Nothing is said."), before=before)
    assert [r.node for r in problems.select("node").distinct().collect()] == ["statement:low"]


def test_quotes_are_looked_for_once(spark):
    """Nodes and problems read what was found; neither looks through the pages again."""
    graph, problems = kn.build(*inputs(spark, quote="Never use"))
    for df in (graph.nodes, problems):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan
    assert problems.count() == 1
